"""Review loop: labels, calibration, rule mining, holdout gate, sampling, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.hashing import hash_bucket
from larkspur.functions.numbers import js_round, safe_ratio


def f1(precision: Column, recall: Column) -> Column:
    return safe_ratio(2.0 * precision * recall, precision + recall)


def resolve_labels(labels: DataFrame, category: str, legacy: bool = False, legacy_category: str = "sofa") -> DataFrame:
    """Labels that speak about one category, with a boolean is_in_category.

    Explicit flag first, then the stated decision, then (legacy) the action.
    Labels without a category count only in legacy mode for the legacy category.
    """
    stated = F.nullif(F.lower(F.trim("label_category")), F.lit(""))
    decision = F.lower(F.trim("label_decision"))
    verdict = F.coalesce(
        F.col("is_in_category"), F.when(decision == "in_category", True).when(decision == "not_category", False),
        F.when(F.lower("action") == "accept", True).when(F.lower("action") == "reject", False) if legacy
        else F.lit(None).cast("boolean"))
    scope = stated == category
    if legacy and category == legacy_category:
        scope = scope | stated.isNull()
    return labels.where(scope).withColumn("is_in_category", verdict).where(F.col("is_in_category").isNotNull())


def calibrate(labels: DataFrame, default_accept: float = 0.60, default_reject: float = 0.20) -> DataFrame:
    """Recommended thresholds from (confidence, correct) labels.

    Every grid point is a set of conditional counts of one global aggregate:
    the labels are read once and never multiplied by the grid.
    """
    grid = [t / 100 for t in range(30, 90, 5)]
    low = [t / 100 for t in range(10, 50, 5)]
    conf, ok = F.col("confidence"), F.col("correct")
    aggs = [F.count("*").alias("total")]
    for i, t in enumerate(grid + [default_accept]):
        aggs += [F.count_if((conf >= t) & ok).alias(f"tp{i}"), F.count_if((conf >= t) & ~ok).alias(f"fp{i}"),
                 F.count_if((conf < t) & ok).alias(f"fn{i}")]
    for i, t in enumerate(low):
        near = F.abs(conf - t) < 0.05
        aggs += [F.count_if(near & ok).alias(f"lt{i}"), F.count_if(near).alias(f"ln{i}")]
    agg = labels.agg(*aggs)
    c = F.col
    point = lambda i, t: F.struct(
        f1(safe_ratio(c(f"tp{i}"), c(f"tp{i}") + c(f"fp{i}")), safe_ratio(c(f"tp{i}"), c(f"tp{i}") + c(f"fn{i}"))).alias("f1"),
        F.lit(-t).alias("neg_t"), safe_ratio(c(f"tp{i}"), c(f"tp{i}") + c(f"fp{i}")).alias("acc"))
    k = len(grid)
    best = F.array_max(F.array(*[point(i, t) for i, t in enumerate(grid)]))
    staged = agg.withColumns({"best": best, "before": point(k, default_accept)})
    reject = F.coalesce(*[F.when((c(f"ln{i}") > 0) & (c(f"lt{i}") / c(f"ln{i}") < 0.3), F.lit(t)) for i, t in enumerate(low)],
                        F.lit(default_reject))
    found = c("best.f1") > 0
    return staged.select(
        "total", js_round(c("before.acc"), 3).alias("accuracy_before"),
        js_round(F.when(found, c("best.acc")).otherwise(c("before.acc")), 3).alias("accuracy_after"),
        F.when(found, -c("best.neg_t")).otherwise(F.lit(default_accept)).alias("accept_threshold"),
        reject.alias("reject_threshold"), js_round(c("best.f1"), 4).alias("best_f1"))


# Words ignored by rule mining.
STOPWORDS = [
    "och", "med", "for", "utan", "the", "and", "som", "att", "this", "that", "from", "till", "hos", "www", "se",
]


def training_tokens(pieces: Column, cap: int | None = None) -> Column:
    """Distinct tokens of 3 to 24 letters over the text pieces, stop-words removed; with `cap` only the first."""
    words = F.flatten(F.transform(pieces, lambda p: F.split(
        F.trim(F.regexp_replace(F.lower(F.coalesce(p, F.lit(""))), "[^a-z0-9åäö]+", " ")), " ")))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & (F.length(w) <= 24) & ~w.isin(*STOPWORDS))
    return F.array_distinct(kept) if cap is None else F.slice(F.array_distinct(kept), 1, cap)


TRAIN_BUCKETS = 8


def split_samples(samples: DataFrame) -> DataFrame:
    """Add `split`: train for 8 of 10 hash buckets of the item id, else holdout."""
    bucket = hash_bucket(F.col("item_id").cast("string"), 10)
    return samples.withColumn("bucket", bucket).withColumn(
        "split", F.when(F.col("bucket") < TRAIN_BUCKETS, "train").otherwise("holdout"))


def mine_image_rules(train: DataFrame) -> DataFrame:
    """Sources whose rejects mostly lack images."""
    agg = train.groupBy("source_id").agg(
        F.count_if(~F.col("is_in_category")).alias("rejects"),
        F.count_if(~F.col("is_in_category") & ~F.col("has_images")).alias("missing"))
    return agg.where((F.col("rejects") >= 5) & (F.col("missing") / F.col("rejects") >= 0.35)).select(
        "source_id", F.lit(True).alias("require_images"))


def mine_reject_tokens(train: DataFrame, top: int = 8) -> DataFrame:
    """Risky tokens per (source, category): support and rejects of at least 3, reject rate of at least 0.75.

    Counts combine map-side before the shuffle, weak tokens are dropped before
    ranking, and the rank limit is applied below the window's shuffle.
    """
    counts = train.select("source_id", "predicted", F.explode("tokens").alias("token"), "is_in_category").groupBy(
        "source_id", "predicted", "token").agg(
        F.count("*").alias("support"), F.count_if(~F.col("is_in_category")).alias("rejects"))
    risky = counts.where((F.col("support") >= 3) & (F.col("rejects") >= 3)).withColumn(
        "reject_rate", F.col("rejects") / F.col("support")).where(F.col("reject_rate") >= 0.75)
    w = Window.partitionBy("source_id", "predicted").orderBy(F.desc("reject_rate"), F.desc("rejects"), "token")
    return risky.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def mine_rules(train: DataFrame) -> DataFrame:
    """Per (source, category) with 8 or more labels: minimum confidence and reject tokens.

    Needs source_id, predicted, is_in_category and tokens.
    """
    totals = train.groupBy("source_id", "predicted").agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_in_category")).alias("rejects")).where(F.col("total") >= 8)
    rate = F.col("rejects") / F.col("total")
    tokens = mine_reject_tokens(train).groupBy("source_id", "predicted").agg(
        F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("_t"))
    return totals.join(tokens, ["source_id", "predicted"], "left").select(
        "source_id", "predicted", "total", "rejects", js_round(rate, 3).alias("reject_rate"),
        F.when((F.col("total") >= 15) & (rate >= 0.55), F.when(rate >= 0.7, 0.75).otherwise(0.65)).alias("min_confidence"),
        F.coalesce(F.transform("_t", lambda s: s["token"]), F.array().cast("array<string>")).alias("reject_tokens"))


def rejected_by_rules(rows: DataFrame, rules: DataFrame, image_rules: DataFrame, target: str) -> DataFrame:
    """Add `rule_rejects`: the rules mined for (source, target category) reject the sample."""
    mine = rules.where(F.col("predicted") == target).select("source_id", "min_confidence", "reject_tokens")
    joined = rows.join(mine, "source_id", "left").join(image_rules, "source_id", "left")
    hit = F.exists(F.coalesce("reject_tokens", F.array().cast("array<string>")), lambda t: F.contains("rule_text", t))
    return joined.withColumn("rule_rejects", (
        (F.coalesce("require_images", F.lit(False)) & ~F.col("has_images"))
        | F.coalesce(F.col("confidence") < F.col("min_confidence"), F.lit(False)) | hit))


def binary_metrics(df: DataFrame, predicted: str, prefix: str) -> list[Column]:
    actual, p = F.col("is_in_category"), F.col(predicted)
    return [F.count_if(p & actual).alias(f"{prefix}_tp"), F.count_if(p & ~actual).alias(f"{prefix}_fp"),
            F.count_if(~p & actual).alias(f"{prefix}_fn")]


MIN_HOLDOUT, MIN_PRECISION_GAIN, MAX_RECALL_LOSS = 40, 0.03, -0.08


def rule_gate(holdout: DataFrame, target: str) -> DataFrame:
    """Holdout precision, recall and F1 before and after the rules, and the promotion verdict.

    Needs predicted, is_in_category and rule_rejects.
    """
    rows = holdout.withColumn("_base", F.col("predicted") == target).withColumn(
        "_adj", F.col("_base") & ~F.col("rule_rejects"))
    agg = rows.agg(F.count("*").alias("holdout"), *binary_metrics(rows, "_base", "base"), *binary_metrics(rows, "_adj", "rule"))
    c = F.col
    out = {}
    for p in ("base", "rule"):
        prec, rec = safe_ratio(c(f"{p}_tp"), c(f"{p}_tp") + c(f"{p}_fp")), safe_ratio(c(f"{p}_tp"), c(f"{p}_tp") + c(f"{p}_fn"))
        out |= {f"{p}_precision": js_round(prec, 4), f"{p}_recall": js_round(rec, 4), f"{p}_f1": js_round(f1(prec, rec), 4)}
    m = agg.withColumns(out)
    dp, dr = js_round(c("rule_precision") - c("base_precision"), 4), js_round(c("rule_recall") - c("base_recall"), 4)
    enough = c("holdout") >= MIN_HOLDOUT
    return m.withColumns({"precision_delta": dp, "recall_delta": dr}).withColumn("verdict", F.when(
        ~enough, "insufficient_holdout").when((c("precision_delta") >= MIN_PRECISION_GAIN) & (c("recall_delta") >= MAX_RECALL_LOSS), "pass")
        .otherwise("precision_or_recall_regression"))


def evaluation_report(labels: DataFrame) -> DataFrame:
    """Per-category precision, recall and F1 from review actions.

    Each label yields at most two (category, tp, fp, fn) rows, summed map-side.
    """
    pred, right, action = F.col("predicted"), F.nullif(F.col("correct_category"), F.lit("")), F.col("action")
    row = lambda cat, tp, fp, fn: F.struct(
        cat.alias("category"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))
    actual = F.coalesce(right, F.when(action == "accept", pred).otherwise("rejected"))
    outcome = (
        F.when((action == "accept") & right.isNull(), F.array(row(pred, 1, 0, 0)))
        .when(action == "reject", F.array(row(pred, 0, 1, 0), row(actual, 0, 0, 0)))
        .when(right.isNotNull() & (right != pred), F.array(row(pred, 0, 1, 0), row(right, 0, 0, 1)))
        .when(right.isNotNull(), F.array(row(pred, 1, 0, 0)))
        .otherwise(F.array(row(pred, 0, 0, 0), row(actual, 0, 0, 0))))
    sums = labels.select(F.inline(outcome)).groupBy("category").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    prec = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": js_round(prec, 3), "recall": js_round(rec, 3), "f1": js_round(f1(prec, rec), 3)})


def uncertainty(probabilities: Column, confidence: Column, margin: Column) -> Column:
    """0.55 entropy + 0.35 (1 - margin) + 0.10 closeness of the confidence to one half."""
    values = F.filter(F.map_values(probabilities), lambda v: v >= 0)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    h = F.aggregate(values, F.lit(0.0), lambda a, v: a - F.when(v > 0, (v / total) * F.ln(v / total)).otherwise(0.0))
    entropy = F.when((F.size(values) > 1) & (total > 0), h / F.ln(F.size(values).cast("double"))).otherwise(0.0)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return (clamp(entropy) * 0.55 + (1.0 - clamp(margin)) * 0.35
            + (1.0 - clamp(F.abs(confidence - 0.5) * 2.0)) * 0.10)


# ---- sampling ------------------------------------------------------------------------------------


def shuffle_key(seed: int = 0) -> Column:
    """Seeded pseudo-random order of items, the same in every engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string")), 256)


def _ordering(strategy: str, seed: int) -> list[Column]:
    if strategy == "uncertain":
        return [F.desc("uncertainty"), F.asc("item_id")]
    return [F.asc(shuffle_key(seed)), F.asc("item_id")]


def sample_items(items: DataFrame, strategy: str, limit: int, seed: int = 0) -> DataFrame:
    """uncertain: highest uncertainty; random: seeded order; diverse: equal share per category, then seeded fill.

    The diverse plan first keeps the best `limit` rows of each category, which
    is enough for any share and fill, so the final order sees few rows.
    """
    if strategy != "diverse":
        return items.orderBy(*_ordering(strategy, seed)).limit(limit)
    w = Window.partitionBy("category").orderBy(*_ordering("random", seed))
    head = items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    share = items.agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.count_distinct("category")))).scalar()
    return head.withColumn("_fill", F.col("_rn") > share).orderBy(
        "_fill", *_ordering("random", seed)).limit(limit).drop("_rn", "_fill")


def _capped_pick(pool: DataFrame, count: Column, limit: int, cap: int, prior: DataFrame, order: list[Column]) -> DataFrame:
    """First `count` of the pool by (over the source cap, order); prior picks count towards the cap.

    Only the best `limit` rows of each source can be picked, so the pool is cut
    to those before it is joined with prior counts and ordered.
    """
    w = Window.partitionBy("source_id").orderBy(*order)
    head = pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    used = prior.groupBy("source_id").agg(F.count("*").alias("_used"))
    over = (F.col("_rn") + F.coalesce("_used", F.lit(0))) > cap
    picked = head.join(used, "source_id", "left").withColumn("_over", over).orderBy("_over", *order).limit(limit)
    ranked = picked.withColumn("_pos", F.row_number().over(Window.orderBy("_over", *order)))
    return ranked.where(F.col("_pos") <= count).drop("_rn", "_used", "_over", "_pos")


def target_sample(items: DataFrame, category: str, limit: int, strategy: str = "random", seed: int = 0,
                  checkpoint=lambda df: df) -> DataFrame:
    """40 % predicted as the target, 40 % hinted near misses, the rest backfill; at most 35 % per source where possible.

    Each stage keeps at most `limit` rows; `checkpoint` may materialise the
    small intermediate picks. Needs item_id, source_id, category, is_hint.
    """
    cap = max(2, -(-limit * 35 // 100))
    part = max(1, limit * 4 // 10)
    order = _ordering(strategy, seed)
    count = lambda df: df.agg(F.count("*")).scalar()
    none = items.where(F.lit(False))
    primary = checkpoint(_capped_pick(items.where(F.col("category") == category), F.lit(min(part, limit)), limit, cap, none, order)
                         .withColumn("reason", F.lit("primary")))
    budget = F.least(F.lit(limit) - count(primary), F.lit(2 * part) - count(primary))
    near = checkpoint(_capped_pick(items.where((F.col("category") != category) & F.col("is_hint")), budget, limit, cap, primary, order)
                      .withColumn("reason", F.lit("near_miss")))
    chosen = primary.unionByName(near)
    rest = items.join(chosen.select("item_id"), "item_id", "left_anti")
    focus = rest.join(chosen.select("source_id").distinct(), "source_id", "left_semi")
    pool = focus.unionByName(rest.where(count(focus) == 0))
    fill = _capped_pick(pool, F.lit(limit) - count(chosen), limit, cap, chosen, order).withColumn("reason", F.lit("backfill"))
    return chosen.unionByName(fill)


def apply_reviews(gold: DataFrame, items: DataFrame, labels: DataFrame) -> DataFrame:
    """Next gold table: the latest non-training label of an item inserts, deletes or recategorises it."""
    latest = labels.where(~F.col("training_only")).groupBy("item_id").agg(
        F.max_by(F.struct("action", "correct_category"), F.struct("created_at", "label_id")).alias("l")).select("item_id", "l.*")
    kept = gold.join(latest.where(F.col("action").isin("accept", "reject")).select("item_id"), "item_id", "left_anti")
    recat = latest.where((F.col("action") == "reclassify") & F.col("correct_category").isNotNull()).select(
        "item_id", F.col("correct_category").alias("_new"))
    kept = kept.join(recat, "item_id", "left").withColumn("category", F.coalesce("_new", "category")).drop("_new")
    added = items.join(latest.where(F.col("action") == "accept").select("item_id"), "item_id", "left_semi").select(
        "item_id", "title", "category", F.lit(True).alias("human_verified"))
    return kept.unionByName(added)


def recipe_gate(results: DataFrame, min_success: float = 0.85, min_completeness: float = 0.75) -> DataFrame:
    """Per recipe: success rate, mean completeness of successes, hard failures and the verdict."""
    agg = results.groupBy("recipe").agg(
        F.count("*").alias("pages"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("hard_failures"),
        F.sum(F.when(F.col("ok"), F.col("completeness")).otherwise(0.0)).alias("_c"))
    rate, comp = safe_ratio(F.col("succeeded"), F.col("pages")), safe_ratio(F.col("_c"), F.col("succeeded"))
    return agg.withColumns({"success_rate": js_round(rate, 4), "avg_completeness": js_round(comp, 4)}).withColumn(
        "passes", (rate >= min_success) & (comp >= min_completeness) & (F.col("hard_failures") == 0)).drop("_c")
