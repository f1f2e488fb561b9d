"""Offline evaluation: liked-in-top-K, oracle slates, variants, ranking study, crawl readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.numbers import js_round, safe_ratio
from larkspur.operators.ranking import jaccard_similarity, preference_topk


def served_items(slates: DataFrame, k: int | None = None) -> DataFrame:
    """Union of served items per session; slates: (session_id, request_id, position, item_id)."""
    rows = slates.where(F.col("position") <= k) if k else slates
    return rows.select("session_id", "item_id").distinct()


def liked_share(slates: DataFrame, likes: DataFrame, k: int | None = None) -> DataFrame:
    """Per session with a like: liked items, served liked items and their share.

    The join runs on (session, item), so a session with very many likes is
    spread over tasks, and the counts combine map-side.
    """
    served = served_items(slates, k).withColumn("_hit", F.lit(1))
    joined = likes.select("session_id", "item_id").distinct().join(served, ["session_id", "item_id"], "left")
    return joined.groupBy("session_id").agg(F.count("*").alias("liked"), F.count("_hit").alias("covered")).withColumn(
        "share", F.col("covered") / F.col("liked"))


def liked_in_topk(slates: DataFrame, likes: DataFrame, k: int | None = None) -> DataFrame:
    return liked_share(slates, likes, k).agg(F.count("*").alias("sessions"), js_round(F.avg("share"), 6).alias("liked_in_topk"))


def first_variants(responses: DataFrame) -> DataFrame:
    return responses.where(F.col("variant").isNotNull()).groupBy("session_id").agg(
        F.min_by("variant", F.struct("ts", "request_id")).alias("variant"))


def by_variant(slates: DataFrame, likes: DataFrame, responses: DataFrame, k: int | None = None) -> DataFrame:
    """The metric per first variant with a normal-approximation 95 % interval."""
    rows = liked_share(slates, likes, k).join(first_variants(responses), "session_id")
    agg = rows.groupBy("variant").agg(F.count("*").alias("sessions"), F.avg("share").alias("m"), F.stddev_samp("share").alias("s"))
    half = F.coalesce(F.col("s"), F.lit(0.0)) * 1.96 / F.sqrt(F.col("sessions").cast("double"))
    return agg.select("variant", "sessions", js_round(F.col("m"), 6).alias("liked_in_topk"),
                      js_round(F.col("m") - half, 6).alias("ci_low"), js_round(F.col("m") + half, 6).alias("ci_high"))


ORACLE_FAMILIES = {"", "material:", "color:", "size:"}


def oracle_topk(weights: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Ground truth: best k active items by plain weight sums of style, material, colour and size, score above zero."""
    return preference_topk(weights, items.where("is_active"), k, families=ORACLE_FAMILIES, normalize=False, positive_only=True)


def slate_diversity(slates: DataFrame) -> DataFrame:
    """1 - mean pairwise similarity per (variant, session); slates are at most `limit` rows each."""
    packed = slates.groupBy("variant", "session_id").agg(F.collect_list(F.struct("position", "tokens")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(
        F.filter("s", lambda b: b["position"] > a["position"]), lambda b: jaccard_similarity(a["tokens"], b["tokens"]))))
    mean = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size("_p"), F.lit(1))
    return packed.select("variant", "session_id", pairs.alias("_p")).select("variant", "session_id", (1.0 - mean).alias("diversity"))


def ranking_study(slates: DataFrame, oracle: DataFrame) -> DataFrame:
    """Coverage, relevance and diversity per variant.

    slates: (variant, session_id, position, item_id, tokens); oracle:
    (session_id, item_id, score).
    """
    sizes = oracle.groupBy("session_id").agg(F.count("*").alias("oracle_items"))
    hits = slates.join(oracle.select("session_id", "item_id", F.col("score").alias("oracle_score")), ["session_id", "item_id"], "left")
    per = hits.groupBy("variant", "session_id").agg(
        F.count("oracle_score").alias("covered"), F.avg(F.coalesce("oracle_score", F.lit(0.0))).alias("relevance")).join(sizes, "session_id")
    both = per.join(slate_diversity(slates), ["variant", "session_id"])
    return both.groupBy("variant").agg(
        F.count("*").alias("sessions"), js_round(F.avg(F.col("covered") / F.col("oracle_items")), 6).alias("coverage"),
        js_round(F.avg("relevance"), 6).alias("relevance"), js_round(F.avg("diversity"), 6).alias("diversity"))


# ---- crawl evaluation ----------------------------------------------------------------------------------


def crawl_eval(pages: DataFrame) -> DataFrame:
    """Per site and overall (site null): completion, full pages, image validity; from one rollup.

    Needs site, accepted, complete, image_urls, valid_images.
    """
    agg = pages.rollup("site").agg(
        F.grouping("site").alias("_all"), F.count("*").alias("pages"), F.count_if("accepted").alias("accepted"),
        F.count_if("complete").alias("complete"), F.sum("image_urls").alias("image_urls"), F.sum("valid_images").alias("valid_images"))
    return agg.select(
        F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("site")).alias("site"), "pages", "accepted", "complete",
        js_round(safe_ratio(F.col("accepted"), F.col("pages")), 4).alias("completion"),
        js_round(safe_ratio(F.col("valid_images"), F.col("image_urls")), 4).alias("image_validity"))


def failure_reasons(pages: DataFrame, label: Column) -> DataFrame:
    return pages.where(F.col("error").isNotNull()).groupBy(label.alias("reason")).agg(F.count("*").alias("pages"))


def readiness(pages: DataFrame, sample: int = 8, ready: float = 0.75) -> DataFrame:
    """Label per host from its first `sample` pages: ready, partial or blocked.

    The sample size belongs to the report. Ranks are limited below the shuffle.
    """
    w = Window.partitionBy("site").orderBy("page_id")
    head = pages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample)
    agg = head.groupBy("site").agg(F.count("*").alias("sampled"), F.count_if("accepted").alias("accepted"))
    share = F.col("accepted") / F.col("sampled")
    return agg.withColumn("label", F.when(share >= ready, "ready").when(share > 0, "partial").otherwise("blocked"))
