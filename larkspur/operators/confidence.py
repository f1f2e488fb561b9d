"""Product confidence: interaction counts by look-back window, score, reasons and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.numbers import js_round, safe_ratio

WINDOWS = {"7d": 7, "30d": 30, "90d": 90}

# Event names that writers emit, by the count they feed.
EVENT_FLAGS = {
    "is_impression": ("impression", "card_impression_start"),
    "is_save": ("save", "swipe_right", "add_like"),
    "is_click": ("click", "outbound_click"),
    "is_skip": ("skip", "swipe_left"),
}
COUNTS = {"impressions": "is_impression", "saves": "is_save", "clicks": "is_click", "skips": "is_skip"}


def map_event_types(events: DataFrame) -> DataFrame:
    """Add the four boolean flags from event_type names."""
    return events.withColumns(
        {flag: F.col("event_type").isin(*names) for flag, names in EVENT_FLAGS.items()}
    )


def product_events(events: DataFrame, as_of: Column, windows: dict[str, int] | None = None) -> DataFrame:
    """One pass over the log: counts per (item, window).

    All windows are conditional counts of a single hash aggregate, so a hot
    item collapses map-side and the log is read once rather than once per
    window and type.
    """
    windows = windows or WINDOWS
    longest = max(windows.values())
    ts = F.col("ts")
    in_range = events.where((ts >= as_of - F.make_dt_interval(F.lit(longest))) & (ts <= as_of))
    aggs = []
    for label, days in windows.items():
        since = ts >= as_of - F.make_dt_interval(F.lit(days))
        aggs += [F.count_if(F.col(flag) & since).alias(f"{out}_{label}") for out, flag in COUNTS.items()]
    wide = in_range.groupBy("item_id").agg(*aggs)
    entries = F.array(*[
        F.struct(F.lit(label).alias("time_window"), *[F.col(f"{out}_{label}").alias(out) for out in COUNTS])
        for label in windows
    ])
    return wide.select("item_id", F.inline(entries))


def volume_score(impressions: Column) -> Column:
    raw = F.log10(impressions.cast("double") + 1.0) / F.log10(F.lit(500.0)) * 100.0
    return F.when(impressions == 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))


def reason_codes(save_rate: Column, click_rate: Column, skip_rate: Column, impressions: Column,
                 creative: Column) -> Column:
    """Array of codes in rule order."""
    return F.array_compact(F.array(
        F.when(save_rate >= 0.05, "STRONG_SAVES")
        .when(save_rate >= 0.03, "GOOD_SAVES")
        .when((save_rate < 0.01) & (impressions >= 50), "LOW_SAVES"),
        F.when(click_rate >= 0.10, "HIGH_CLICKS")
        .when((click_rate < 0.02) & (impressions >= 50), "LOW_CLICKS"),
        F.when(skip_rate >= 0.8, "HIGH_SKIP"),
        F.when(impressions < 20, "LOW_VOLUME").when(impressions >= 500, "HIGH_CONFIDENCE"),
        F.when(creative >= 80, "EXCELLENT_CREATIVE").when(creative < 50, "CREATIVE_ISSUES"),
    ))


REASON_LABELS = {
    "STRONG_SAVES": ("Strong save rate (5%+)", "positive"),
    "GOOD_SAVES": ("Good save rate", "positive"),
    "LOW_SAVES": ("Low save rate (<1%)", "negative"),
    "HIGH_CLICKS": ("High click-through (10%+)", "positive"),
    "LOW_CLICKS": ("Low engagement clicks", "negative"),
    "HIGH_SKIP": ("Frequently skipped (80%+)", "negative"),
    "LOW_VOLUME": ("Limited data (needs more impressions)", "neutral"),
    "HIGH_CONFIDENCE": ("High confidence (500+ impressions)", "positive"),
    "EXCELLENT_CREATIVE": ("Excellent image quality", "positive"),
    "CREATIVE_ISSUES": ("Image quality concerns", "negative"),
}


def describe_reasons(codes: Column) -> Column:
    """Codes to structs with label and impact."""
    table = F.create_map(*[
        F.lit(x) if not isinstance(x, tuple) else F.struct(F.lit(x[0]).alias("label"), F.lit(x[1]).alias("impact"))
        for kv in REASON_LABELS.items() for x in kv
    ])
    return F.transform(codes, lambda c: F.struct(
        c.alias("code"), table[c]["label"].alias("label"), table[c]["impact"].alias("impact")))


def score_band(score: Column) -> Column:
    return F.when(score >= 60, "green").when(score >= 30, "yellow").otherwise("red")


def confidence_scores(items: DataFrame, events: DataFrame, as_of: Column,
                      windows: dict[str, int] | None = None) -> DataFrame:
    """Score every active item in every window; items without events score on the priors.

    Needs items(item_id, is_active, creative_score) and flagged events.
    """
    windows = windows or WINDOWS
    counts = product_events(events, as_of, windows)
    grid = items.where(F.col("is_active")).select(
        "item_id", "creative_score", F.explode(F.array(*[F.lit(w) for w in windows])).alias("time_window"))
    joined = grid.join(counts, ["item_id", "time_window"], "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS}
    base = joined.select("item_id", "time_window", "creative_score", *[n[c].alias(c) for c in COUNTS])
    imp, creative = F.col("impressions"), F.col("creative_score")
    rated = base.withColumns({
        "save_ratio": safe_ratio(F.col("saves"), imp),
        "click_ratio": safe_ratio(F.col("clicks"), imp),
        "skip_ratio": safe_ratio(F.col("skips"), imp),
    })
    smoothed = (F.col("saves") + 2.0) / (imp + 100.0)
    weighted = (
        F.least(F.lit(100.0), smoothed * 2000.0) * 50.0
        + F.least(F.lit(100.0), F.col("click_ratio") * 1000.0) * 15.0
        + volume_score(imp) * 15.0
        + F.coalesce(creative, F.lit(70.0)) * 20.0
    ) / 100.0
    score = F.least(F.lit(100), F.greatest(F.lit(0), js_round(weighted))).cast("bigint")
    return rated.withColumn("score", score).select(
        "item_id", "time_window", "score", score_band(F.col("score")).alias("band"),
        "impressions", "saves", "clicks", "skips",
        (js_round(F.col("save_ratio") * 10000.0) / 100.0).alias("save_rate"),
        (js_round(F.col("click_ratio") * 10000.0) / 100.0).alias("click_rate"),
        (js_round(F.col("skip_ratio") * 10000.0) / 100.0).alias("skip_rate"),
        "creative_score",
        reason_codes(F.col("save_ratio"), F.col("click_ratio"), F.col("skip_ratio"), imp, creative)
        .alias("reason_codes"),
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Count, rounded mean, band counts and band percentages per window."""
    band = lambda b: F.count_if(score_band(F.col("score")) == b)
    agg = scores.groupBy("time_window").agg(
        F.count("*").alias("total_products"), F.avg("score").alias("_mean"),
        band("green").alias("green"), band("yellow").alias("yellow"), band("red").alias("red"))
    pct = lambda b: js_round(F.col(b) / F.col("total_products") * 100.0).alias(f"pct_{b}")
    return agg.select("time_window", "total_products", js_round(F.col("_mean")).alias("average_score"),
                      "green", "yellow", "red", pct("green"), pct("yellow"), pct("red"))


def query_scores(scores: DataFrame, time_window: str = "30d", item_ids: list[int] | None = None,
                 band: str | None = None, limit: int = 50) -> DataFrame:
    """Best scores of one window, of one band if it is given."""
    out = scores.where(F.col("time_window") == time_window)
    if item_ids:
        out = out.where(F.col("item_id").isin(item_ids))
    if band:
        out = out.where(F.col("band") == band)
    return out.orderBy(F.desc("score"), "item_id").limit(limit)


def product_scores(scores: DataFrame, item_id: int) -> DataFrame:
    return scores.where(F.col("item_id") == item_id).orderBy(F.desc("score"), "time_window")
