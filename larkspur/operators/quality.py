"""Catalog quality, image health, crawl metrics, drift and cost aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.numbers import js_round, safe_ratio
from larkspur.functions.url import is_image_url


def catalog_qa(items: DataFrame) -> DataFrame:
    """Counts of missing fields over active items, in one pass."""
    c = F.col
    return items.where(c("is_active")).agg(
        F.count("*").alias("total"),
        F.count_if(c("price_amount").isNull() | (c("price_amount") == 0)).alias("missing_price"),
        F.count_if(c("width_cm").isNull() & c("height_cm").isNull()).alias("missing_dimensions"),
        F.count_if(F.coalesce(c("image_count"), F.lit(0)) == 0).alias("missing_images"),
        F.count_if(F.coalesce(F.trim("outbound_url"), F.lit("")) == "").alias("missing_outbound_url"),
        F.count_if(F.coalesce(F.size("style_tags"), F.lit(0)) <= 0).alias("missing_tags"))


def needs_validation(items: DataFrame) -> Column:
    """True unless validated with analysed images, a selected image, a scene and a score."""
    done = ((F.col("analyzed_images") > 0) & (F.coalesce(F.trim("selected_image"), F.lit("")) != "")
            & (F.coalesce(F.trim("scene_type"), F.lit("")) != "") & F.col("creative_score").isNotNull())
    return ~F.coalesce(F.col("validated") & done, F.lit(False))


COMPLETENESS_WEIGHTS = {"title": 3, "canonical": 3, "images": 2, "price_amount": 2, "price_currency": 1,
                        "description": 2, "dimensions": 1, "material": 1, "color": 1, "brand": 1}


def completeness(flags: dict[str, Column]) -> Column:
    """Share of the field weights present; flags are booleans by field name."""
    got = sum((F.when(F.coalesce(flags[f], F.lit(False)), w).otherwise(0)
               for f, w in COMPLETENESS_WEIGHTS.items() if f in flags), F.lit(0))
    return got / float(sum(COMPLETENESS_WEIGHTS.values()))


def refetch_candidates(items: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Low-completeness items fetched over http and not updated for a day."""
    out = items.where(
        (F.coalesce("completeness", F.lit(0.0)) < 0.6) & (F.lower("fetch_method") == "http")
        & F.coalesce(F.col("updated_at") <= as_of - F.make_dt_interval(F.lit(1)), F.lit(True)))
    return out.limit(limit) if limit else out


# ---- creative scores ---------------------------------------------------------------------


def display_band(score: Column) -> Column:
    return F.when(score >= 75, "green").when(score >= 45, "yellow").otherwise("red")


def scene_type(metrics: DataFrame) -> DataFrame:
    """Scene class, issues and display suitability from six image ratios."""
    c = F.col
    cutout = (c("transparent_ratio") >= 0.08) & (c("background_ratio") >= 0.66) & (c("border_ratio") >= 0.72)
    white = (c("near_white_ratio") >= 0.62) & (c("border_ratio") >= 0.78) & (c("background_ratio") >= 0.68)
    context = ((c("background_ratio") <= 0.58) & (c("border_ratio") <= 0.62) & (c("texture_score") >= 0.09)
               & (c("subject_coverage") >= 0.35))
    scene = (F.when(cutout | (white & (c("texture_score") < 0.07)), "studio_cutout")
             .when(context, "contextual").otherwise("unknown"))
    shortest = F.least("width", "height")
    points = lambda cond, w: F.when(cond, w).otherwise(0)
    suitability = (
        70 + F.when(shortest < 400, -45).when(shortest < 800, -15).when(shortest >= 1200, 8).otherwise(0)
        + points(c("scene_type") == "contextual", 18) - points(c("scene_type") == "studio_cutout", 25)
        - points(c("transparent_ratio") >= 0.12, 12)
        - points((c("near_white_ratio") >= 0.7) & (c("border_ratio") >= 0.78), 8)
        + js_round((c("texture_score") - 0.08) * 120.0) - js_round(F.abs(c("subject_coverage") - 0.55) * 20.0))
    issues = F.array_compact(F.array(
        F.when(c("transparent_ratio") >= 0.12, "transparent-background"), F.when(white, "white-background"),
        F.when(c("scene_type") == "studio_cutout", "studio-cutout"),
        F.when((c("scene_type") != "contextual") & (c("background_ratio") >= 0.72), "low-context-scene")))
    return metrics.withColumn("scene_type", scene).withColumns({
        "display_suitability": F.when(c("valid"), F.least(F.lit(100), F.greatest(F.lit(0), suitability))).otherwise(0).cast("bigint"),
        "scene_issues": issues})


ISSUE_PENALTIES = {"low-resolution": 20, "extreme-aspect-ratio": 15, "transparent-background": 8,
                   "white-background": 8, "studio-cutout": 12}


def image_creative_score() -> Column:
    """0-100 from size, aspect, issues and display suitability; invalid images score 0."""
    shortest, ratio = F.least("width", "height"), F.col("width") / F.col("height")
    structural = (
        100 - F.when(shortest < 400, 40).when(shortest < 800, 15).otherwise(0)
        - F.when((ratio > 3.0) | (ratio < 0.33), 25).when((ratio > 1.8) | (ratio < 0.6), 10).otherwise(0)
        - sum((F.when(F.array_contains("issues", i), p).otherwise(0) for i, p in ISSUE_PENALTIES.items()), F.lit(0)))
    blended = js_round(structural * 0.45 + F.col("display_suitability") * 0.55)
    return F.when(F.col("valid"), F.least(F.lit(100), F.greatest(F.lit(0), blended))).otherwise(0).cast("bigint")


def creative_scores(images: DataFrame) -> DataFrame:
    """Per item: best display image, item score and band.

    Valid images that are not cut-outs are preferred, then the rank score,
    then the first position; all of it is one max_by per item.
    """
    scored = images.withColumn("creative", image_creative_score())
    rank = (F.col("display_suitability") * 0.7 + F.col("creative") * 0.3
            + F.when(F.col("scene_type") == "contextual", 6.0).when(F.col("scene_type") == "studio_cutout", -6.0).otherwise(0.0)
            - F.when(F.col("valid"), 0.0).otherwise(20.0))
    eligible = F.col("valid") & (F.col("scene_type") != "studio_cutout")
    best = scored.withColumn("_rank", js_round(rank, 4)).groupBy("item_id").agg(
        F.max_by(F.struct("position", "creative", "scene_type"),
                 F.struct(eligible.cast("int"), F.col("_rank"), -F.col("position"))).alias("b"),
        F.sum("creative").alias("_sum"), F.count("*").alias("images"))
    item = js_round(F.col("b.creative") * 0.75 + F.col("_sum") / F.col("images") * 0.25)
    return best.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), item)).cast("bigint")).select(
        "item_id", F.col("b.position").alias("selected_position"), F.col("b.scene_type").alias("scene_type"),
        "images", "score", display_band(F.col("score")).alias("band"))


def image_score_v1() -> Column:
    """Older image rule: resolution, aspect and file size only."""
    shortest, ratio = F.least("width", "height"), F.col("width") / F.col("height")
    score = (100 - F.when(shortest < 400, 40).when(shortest < 800, 15).otherwise(0)
             - F.when((ratio > 3.0) | (ratio < 1.0 / 3.0), 25).when((ratio > 1.8) | (ratio < 0.6), 10).otherwise(0)
             - F.when(F.col("file_size") < 10000, 20).when(F.col("file_size") > 5000000, 10).otherwise(0))
    return F.when(F.col("valid"), F.greatest(F.lit(0), score)).otherwise(0).cast("bigint")


def creative_scores_v1(images: DataFrame) -> DataFrame:
    """Older item rule: primary image 0.7, mean of the rest 0.3; an invalid primary caps at 25."""
    scored = images.withColumn("s", image_score_v1())
    agg = scored.groupBy("item_id").agg(
        F.min_by("s", "position").alias("p"), F.min_by("valid", "position").alias("primary_valid"),
        F.sum("s").alias("total"), F.count("*").alias("images"), F.count_if("valid").alias("valid_images"))
    rest = (F.col("total") - F.col("p")) / (F.col("images") - 1)
    overall = F.when(F.col("images") == 1, F.col("p")).otherwise(F.floor(F.col("p") * 0.7 + rest * 0.3 + 1e-9))
    capped = F.when(F.col("primary_valid"), overall).otherwise(F.least(overall, F.lit(25))).cast("bigint")
    return agg.withColumn("score", capped).select(
        "item_id", "images", "valid_images", "primary_valid", "score", display_band(F.col("score")).alias("band"))


def creative_stats(items: DataFrame) -> DataFrame:
    """Bands, scenes and means over active items in one row."""
    c, has = F.col, F.col("creative_score").isNotNull()
    return items.where(c("is_active")).agg(
        F.count("*").alias("total"), F.count_if(has).alias("validated"), F.count_if(~has).alias("not_validated"),
        *[F.count_if(has & (c("band") == b)).alias(b) for b in ("green", "yellow", "red")],
        F.count_if(has & (c("scene_type") == "contextual")).alias("contextual"),
        F.count_if(has & (c("scene_type") == "studio_cutout")).alias("studio_cutout"),
        F.count_if(has & ~F.coalesce(c("scene_type"), F.lit("unknown")).isin("contextual", "studio_cutout")).alias("unknown_scene"),
        F.coalesce(js_round(F.avg("creative_score")), F.lit(0)).alias("average_score"))


def issue_counts(items: DataFrame) -> DataFrame:
    return (items.where(F.col("is_active") & F.col("creative_score").isNotNull())
            .select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("items")))


def image_health(items: DataFrame, samples: int = 3) -> DataFrame:
    """Per source: valid, none and likely broken counts, health percent and sample titles.

    Samples are cut by a rank limit below the shuffle and then listed, so no
    task ever holds a whole source.
    """
    urls = F.coalesce(F.col("image_urls"), F.array().cast("array<string>"))
    status = F.when(F.size(urls) == 0, "none").when(F.exists(urls, is_image_url), "valid").otherwise("broken")
    tagged = items.withColumn("_status", status)
    count = lambda s: F.count_if(F.col("_status") == s)
    stats = tagged.groupBy("source_id").agg(
        F.count("*").alias("total_items"), count("valid").alias("valid_image"), count("none").alias("no_image"),
        count("broken").alias("likely_broken"))
    w = Window.partitionBy("source_id").orderBy("item_id")
    picks = (tagged.where("_status = 'broken'").select("source_id", "item_id", "title")
             .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= samples)
             .groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "title"))).alias("_s")))
    return stats.join(picks, "source_id", "left").select(
        "source_id", "total_items", "valid_image", "no_image", "likely_broken",
        js_round(F.col("valid_image") / F.col("total_items") * 100.0, 1).alias("health_pct"),
        F.coalesce(F.transform("_s", lambda s: s["title"]), F.array().cast("array<string>")).alias("samples"))


def classification_stats(items: DataFrame) -> DataFrame:
    """Counts by category, by decision and by source from one scan (grouping sets)."""
    # Copies of the grouped columns stay readable under every grouping set.
    base = items.where(F.col("is_active")).select(
        "source_id", "category", F.coalesce("decision", F.lit("unprocessed")).alias("decision"),
        F.col("category").isNotNull().alias("_classified"), (F.col("decision") == "ACCEPT").alias("_accepted"))
    cube = base.groupingSets(
        [[F.col("category")], [F.col("decision")], [F.col("source_id")]],
        F.col("category"), F.col("decision"), F.col("source_id"),
    ).agg(F.grouping("category").alias("_gc"), F.grouping("decision").alias("_gd"), F.count("*").alias("total"),
          F.count_if("_classified").alias("classified"), F.count_if("_accepted").alias("accepted"))
    dim = F.when(F.col("_gc") == 0, "category").when(F.col("_gd") == 0, "decision").otherwise("source")
    value = F.when(F.col("_gc") == 0, F.coalesce("category", F.lit("unclassified"))).when(
        F.col("_gd") == 0, F.col("decision")).otherwise(F.col("source_id").cast("string"))
    return cube.select(dim.alias("dimension"), value.alias("value"), "total", "classified", "accepted")


def source_summary(items: DataFrame, top: int = 8) -> DataFrame:
    """Largest sources by active items with their classified count."""
    return (items.where(F.col("is_active")).groupBy("source_id")
            .agg(F.count("*").alias("active_items"), F.count("category").alias("classified"))
            .orderBy(F.desc("active_items"), "source_id").limit(top))


# ---- dated metrics ------------------------------------------------------------------------


def metrics_daily(pages: DataFrame) -> DataFrame:
    """Per source and day: success rate, method shares, field rates and mean completeness.

    Needs success and field flags per extracted page; rates are over successes.
    """
    ok = F.col("success")
    n_ok = F.count_if(ok)
    rate = lambda cond: safe_ratio(F.count_if(ok & cond), n_ok)
    return pages.groupBy("source_id", "dt").agg(
        F.count("*").alias("urls_extracted"), n_ok.alias("successes"), safe_ratio(n_ok, F.count("*")).alias("success_rate"),
        safe_ratio(F.sum(F.when(ok, F.col("completeness")).otherwise(0.0)), n_ok).alias("avg_completeness"),
        rate(F.col("method") == "jsonld").alias("jsonld_rate"),
        rate(F.col("method") == "embedded_json").alias("embedded_json_rate"),
        rate(F.col("method") == "dom").alias("dom_rate"),
        rate(F.col("has_description")).alias("description_rate"),
        rate(F.col("has_dimensions")).alias("dimensions_rate"))


def domain_dashboard(metrics: DataFrame, items: DataFrame) -> DataFrame:
    """Latest metrics, day count and classification counts per source."""
    latest = metrics.groupBy("source_id").agg(
        F.max_by(F.struct("dt", "success_rate", "avg_completeness"), "dt").alias("l"),
        F.count("*").alias("history_days"), F.avg("success_rate").alias("mean_success_rate"))
    stats = items.where(F.col("is_active")).groupBy("source_id").agg(
        F.count("*").alias("items"), F.count("category").alias("classified"),
        F.count_if(F.col("decision") == "ACCEPT").alias("accepted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return latest.join(stats, "source_id", "left").select(
        "source_id", F.col("l.dt").alias("latest_dt"), F.col("l.success_rate").alias("success_rate"),
        F.col("l.avg_completeness").alias("avg_completeness"), "history_days", "mean_success_rate",
        zero("items"), zero("classified"), zero("accepted"))


def drift(metrics: DataFrame, min_success: float = 0.70, max_drop: float = 0.20, rows: int = 7) -> DataFrame:
    """Each day against the mean of the previous rows of its source.

    Runs on the daily table, so a source contributes one row per day to its
    window whatever its page count.
    """
    w = Window.partitionBy("source_id").orderBy("dt").rowsBetween(-rows, -1)
    base = metrics.withColumns({
        "baseline_success": F.avg("success_rate").over(w), "baseline_completeness": F.avg("avg_completeness").over(w)})
    reasons = F.array_compact(F.array(
        F.when(F.col("success_rate") < min_success, f"success_rate_below_{min_success}"),
        F.when(js_round(F.col("baseline_completeness") - F.col("avg_completeness"), 9) >= max_drop, f"avg_completeness_drop_{max_drop}")))
    return base.withColumn("reasons", reasons).withColumn("triggered", F.size("reasons") > 0)


def latest_per_source(df: DataFrame) -> DataFrame:
    others = [c for c in df.columns if c != "source_id"]
    return df.groupBy("source_id").agg(F.max_by(F.struct(*others), "dt").alias("_l")).select("source_id", "_l.*")


def cost_telemetry(runs: DataFrame) -> DataFrame:
    """Runs, fetched, written and durations per source, with the last run's status."""
    first_positive = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b), F.lit(0))
    agg = runs.groupBy("source_id").agg(
        F.count("*").alias("total_runs"), F.sum(first_positive("fetched", "candidate_urls")).alias("total_fetched"),
        F.sum(first_positive("success", "upserted")).alias("total_items_written"),
        F.sum(F.col("duration_sec").cast("bigint")).alias("total_duration_sec"),
        F.max_by("status", F.struct("started_at", "run_id")).alias("last_run_status"))
    per_run = lambda c: js_round(F.col(c) / F.col("total_runs"), 1)
    return agg.withColumns({"avg_duration_sec": per_run("total_duration_sec"), "avg_fetch_per_run": per_run("total_fetched")})
