"""Operational dashboards: funnel, latency regression, deck quality, weekly cohorts, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.numbers import js_round, safe_ratio

# Alert thresholds and minimum samples.
LATENCY_ALERT, LATENCY_SAMPLES = 0.15, 30
REPEAT_ALERT, REPEAT_SAMPLES = 0.2, 20
RECYCLED_ALERT, FALLBACK_SAMPLES = 0.08, 20
SUBMIT_ALERT, SUBMIT_SAMPLES = 0.02, 20


def _since(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def funnel(events: DataFrame, completed_profiles: DataFrame, as_of: Column, days: int = 1) -> DataFrame:
    """Onboarding counts, rates and the failed-submission alert of the window."""
    now = events.where(F.col("ts") >= _since(as_of, days))
    names = {"shown": "intro_shown", "viewed": "step_viewed", "completed": "step_completed", "confirmed": "summary_confirmed", "skipped": "skipped"}
    counts = now.agg(*[F.count_if(F.col("event_name") == n).alias(c) for c, n in names.items()])
    attempted = now.where(F.col("event_name") == "summary_confirmed").select("session_id").distinct().agg(F.count("*")).scalar()
    done = completed_profiles.agg(F.count("*")).scalar()
    c = F.col
    base = counts.withColumns({"attempted_sessions": attempted, "completed_profiles": done})
    failed = F.greatest(F.lit(0), c("attempted_sessions") - c("completed_profiles"))
    rate = safe_ratio(failed, c("attempted_sessions"))
    return base.withColumns({
        "completion_rate_pct": js_round(safe_ratio(c("confirmed"), c("shown")) * 100.0, 2),
        "skip_rate_pct": js_round(safe_ratio(c("skipped"), c("shown")) * 100.0, 2),
        "submit_failure_pct": js_round(rate * 100.0, 2),
        "submit_alert": (c("attempted_sessions") >= SUBMIT_SAMPLES) & (rate > SUBMIT_ALERT)})


def latency_regression(responses: DataFrame, as_of: Column, current_days: int = 1, baseline_days: int = 8) -> DataFrame:
    """p95 latency of the current window against the days before it (nearest rank), with the alert.

    Responses collapse map-side to a histogram per millisecond, so the ranks
    run over distinct latencies only.
    """
    side = F.when(F.col("ts") >= _since(as_of, current_days), "current").otherwise("baseline")
    hist = responses.where(F.col("ts") >= _since(as_of, baseline_days)).groupBy(side.alias("side"), "latency_ms").agg(F.count("*").alias("n"))
    w = Window.partitionBy("side")
    ranked = hist.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("latency_ms"))})
    p95 = ranked.where(F.col("upto") >= F.ceil(F.col("total") * 95 / 100)).groupBy("side").agg(
        F.min("latency_ms").alias("p95"), F.first("total").alias("samples"))
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    row = p95.agg(pick("current", "p95").alias("p95_current"), pick("baseline", "p95").alias("p95_baseline"),
                  F.coalesce(pick("current", "samples"), F.lit(0)).alias("current_samples"),
                  F.coalesce(pick("baseline", "samples"), F.lit(0)).alias("baseline_samples"))
    change = F.coalesce(safe_ratio(F.col("p95_current") - F.col("p95_baseline"), F.col("p95_baseline")), F.lit(0.0))
    return row.withColumns({
        "regression_pct": js_round(change * 100.0, 2),
        "alert": (F.col("current_samples") >= LATENCY_SAMPLES) & (F.col("baseline_samples") >= LATENCY_SAMPLES) & (change > LATENCY_ALERT)})


def deck_quality(responses: DataFrame, as_of: Column, days: int = 1) -> DataFrame:
    """Means of the slate metrics, fallback rates and their alerts."""
    c = F.col
    agg = responses.where(c("ts") >= _since(as_of, days)).agg(
        F.count("*").alias("samples"), F.avg("same_family_top8_rate").alias("_rep"), F.avg("style_distance_top4_min").alias("_dist"),
        F.count_if(c("fallback_stage") == "recycled_seen_items").alias("recycled"),
        F.count_if(c("fallback_stage") == "catalog_exhausted").alias("exhausted"))
    recycled = safe_ratio(c("recycled"), c("samples"))
    return agg.select(
        "samples", js_round(c("_rep"), 4).alias("same_family_top8_rate"), js_round(c("_dist"), 4).alias("style_distance_top4_min"),
        "recycled", "exhausted", js_round(recycled, 4).alias("recycled_rate"),
        js_round(safe_ratio(c("exhausted"), c("samples")), 4).alias("exhausted_rate"),
        ((c("samples") >= REPEAT_SAMPLES) & (F.coalesce("_rep", F.lit(0.0)) > REPEAT_ALERT)).alias("repeat_alert"),
        ((c("samples") >= FALLBACK_SAMPLES) & ((c("exhausted") > 0) | (recycled > RECYCLED_ALERT))).alias("fallback_alert"))


def weekly_cohorts(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Cohort table by experiment variant: the event's own, else the session's first, else unknown.

    Flags first collapse per (cohort, session), so session counts are plain
    sums instead of several distinct aggregates.
    """
    week = events.where(F.col("ts") >= _since(as_of, days))
    first = week.where(F.col("rank_variant").isNotNull()).groupBy("session_id").agg(
        F.min_by("rank_variant", F.struct("ts", "event_id")).alias("_first"))
    tagged = week.join(first, "session_id", "left").withColumn("cohort", F.coalesce("rank_variant", "_first", F.lit("unknown")))
    is_ = lambda n: F.col("event_name") == n
    per = tagged.groupBy("cohort", "session_id").agg(
        *[F.max(is_(n).cast("int")).alias(c) for c, n in (("intro", "intro_shown"), ("confirmed", "summary_confirmed"), ("skipped", "skipped"))],
        F.count_if(is_("deck_response")).alias("deck"), F.count_if(is_("swipe_right")).alias("right"), F.count_if(is_("swipe_left")).alias("left"),
        F.sum(F.when(is_("deck_response"), F.col("same_family_top8_rate"))).alias("rep"),
        F.count(F.when(is_("deck_response"), F.col("same_family_top8_rate"))).alias("rep_n"))
    agg = per.groupBy("cohort").agg(F.count("*").alias("sessions"), *[
        F.sum(c).alias(c) for c in ("intro", "confirmed", "skipped", "deck", "right", "left", "rep", "rep_n")])
    pct = lambda a, b: js_round(safe_ratio(F.col(a), b) * 100.0, 2)
    swipes = F.col("right") + F.col("left")
    return agg.select(
        "cohort", "sessions", F.col("intro").alias("intro_sessions"), F.col("confirmed").alias("confirmed_sessions"),
        F.col("skipped").alias("skipped_sessions"), pct("confirmed", F.col("intro")).alias("completion_rate_pct"),
        pct("skipped", F.col("intro")).alias("skip_rate_pct"), F.col("right").alias("swipes_right"), F.col("left").alias("swipes_left"),
        F.when(swipes > 0, pct("right", swipes)).alias("right_rate_pct"), F.col("deck").alias("deck_responses"),
        F.when(F.col("rep_n") > 0, js_round(F.col("rep") / F.col("rep_n"), 2)).alias("same_family_rate"))


def totals(sessions: DataFrame, swipes: DataFrame, likes: DataFrame, clicks: DataFrame) -> DataFrame:
    n = lambda df: df.agg(F.count("*")).scalar()
    return sessions.agg(F.count("*").alias("daily_sessions")).withColumns(
        {"swipes": n(swipes), "likes": n(likes), "outbound_clicks": n(clicks)}).withColumn(
        "like_rate_pct", js_round(safe_ratio(F.col("likes"), F.col("swipes")) * 100.0, 2))
