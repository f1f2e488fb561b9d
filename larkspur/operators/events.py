"""Event log: payload rules, QA invariants, dwell buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.staging import pin

# Columns every event needs, and per-event required columns with the rejection text.
BASE_FIELDS = ("event_id", "event_name", "session_id", "client_seq", "created_at_client", "platform")
PAYLOAD_RULES = [
    (("deck_response",), ("ranker_run_id", "algorithm_version", "served_items"), "deck_response requires rank"),
    (("card_impression_start",), ("item_id", "position_in_deck"), "card_impression_start requires item"),
    (("card_impression_start",), ("impression_id",), "card_impression_start requires impression"),
    (("card_impression_end",), ("item_id", "position_in_deck"), "card_impression_end requires item"),
    (("card_impression_end",), ("impression_id", "visible_ms", "end_reason"), "card_impression_end requires impression"),
    (("swipe_left", "swipe_right"), ("item_id", "position_in_deck"), "swipe requires item"),
    (("swipe_left", "swipe_right"), ("gesture", "direction"), "swipe requires interaction"),
    (("filters_apply",), ("filters_active",), "filters_apply requires filters.active"),
    (("outbound_click",), ("item_id",), "outbound_click requires item"),
    (("outbound_click",), ("destination_domain",), "outbound_click requires outbound"),
    (("detail_open",), ("item_id", "surface_name"), "detail_open requires item and surface"),
    (("compare_open",), ("item_count", "compare_count"), "compare_open requires items and compare"),
    (("shortlist_create",), ("item_count", "shortlist_id"), "shortlist_create requires items and share"),
]
MIN_EVENT_ID = 8


def _present(df: DataFrame, name: str) -> Column:
    """Column present and, for text, not blank."""
    if name not in df.columns:
        return F.lit(False)
    text = dict(df.dtypes)[name] == "string"
    return F.col(name).isNotNull() & (F.trim(name) != "" if text else F.lit(True))


def event_error(df: DataFrame) -> Column:
    """First broken rule of an event as text; null for a valid event."""
    missing = F.lit(False)
    for f in BASE_FIELDS:
        missing = missing | F.col(f).isNull()
    expr = F.when(missing, "missing required fields").when(F.length("event_id") < MIN_EVENT_ID, "invalid eventId")
    for names, fields, message in PAYLOAD_RULES:
        ok = F.lit(True)
        for f in fields:
            ok = ok & _present(df, f)
        expr = expr.when(F.col("event_name").isin(*names) & ~ok, message)
    return expr


def validate_events(df: DataFrame) -> DataFrame:
    """Events with an `error` column; split on error IS NULL for the two outputs."""
    return pin(df, error=event_error(df))


def sequence_violations(events: DataFrame) -> DataFrame:
    """Events whose client_seq does not exceed the previous one of their session.

    The check runs per (session, day) and then once over the day summaries, so
    a session that holds much of the log is spread over its days.
    """
    dated = events.withColumn("_day", F.to_date("ts"))
    order = [F.col("ts"), F.col("event_id")]
    inside = dated.withColumn("_prev", F.lag("client_seq").over(Window.partitionBy("session_id", "_day").orderBy(*order)))
    within = inside.where(F.col("client_seq") <= F.col("_prev")).select("session_id", "event_id")
    key = F.struct("ts", "event_id")
    days = dated.groupBy("session_id", "_day").agg(
        F.min_by(F.struct("client_seq", "event_id"), key).alias("first"), F.max_by("client_seq", key).alias("last_seq"))
    carried = days.withColumn("_prev", F.lag("last_seq").over(Window.partitionBy("session_id").orderBy("_day")))
    across = carried.where(F.col("first.client_seq") <= F.col("_prev")).select("session_id", F.col("first.event_id").alias("event_id"))
    return within.unionByName(across)


def unmatched_ends(events: DataFrame) -> DataFrame:
    """Impression ends without a start of the same impression id."""
    starts = events.where(F.col("event_name") == "card_impression_start").select("impression_id")
    ends = events.where((F.col("event_name") == "card_impression_end") & F.col("impression_id").isNotNull())
    return ends.join(starts, "impression_id", "left_anti")


def event_qa(events: DataFrame) -> DataFrame:
    """Violation count per invariant."""
    one = lambda df, name: df.agg(F.lit(name).alias("invariant"), F.count("*").alias("violations"))
    missing = lambda names, cond: events.where(F.col("event_name").isin(*names) & cond)
    return (one(sequence_violations(events), "client_seq_increases")
            .unionByName(one(unmatched_ends(events), "impression_end_has_start"))
            .unionByName(one(missing(("filters_apply",), F.col("filters_active").isNull()), "filters_snapshot_present"))
            .unionByName(one(missing(("swipe_left", "swipe_right"), F.col("item_id").isNull() | F.col("position_in_deck").isNull()),
                             "swipe_has_item_and_position"))
            .unionByName(one(missing(("outbound_click",), F.col("destination_domain").isNull()), "outbound_has_domain")))


def dwell_bucket(ms: Column) -> Column:
    return (F.when(ms < 1000, "0_1s").when(ms < 3000, "1_3s").when(ms < 8000, "3_8s").when(ms >= 8000, "8s_plus"))


def dwell_buckets(events: DataFrame) -> DataFrame:
    ends = events.where((F.col("event_name") == "card_impression_end") & F.col("visible_ms").isNotNull())
    return ends.groupBy(dwell_bucket(F.col("visible_ms")).alias("bucket")).agg(
        F.count("*").alias("impressions"), F.sum("visible_ms").alias("total_ms"))
