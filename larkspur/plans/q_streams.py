"""Streaming queries: each drains the table as a file stream and returns the resulting table."""

from __future__ import annotations


from pyspark.sql import functions as F

from larkspur.plans.q_preferences import BOUNDS, WEIGHTS
from larkspur.plans.q_quality import _ERROR
from larkspur.plans.registry import query
from larkspur.session import unique_dir
from larkspur.sources.bindings import SPARK, VIEWS
from larkspur.streaming import jobs as S


def stream_view(t, view: str, raw: str):
    """A bound view with its raw table replaced by a file stream."""
    source = S.read_files(t.spark, t.sf_dir, getattr(t, raw).schema, f"{raw}.parquet")
    deps, fn = VIEWS[view]
    frames = {d: source if d == raw else stream_view(t, d, raw) for d in deps}
    out = t.spark.sql(SPARK.finish(fn(SPARK)), **frames)
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out


def drain(t, name: str, df, mode: str, sink=None) -> str:
    base = unique_dir(t.spark, name)
    S.start(df, f"{base}/checkpoint", sink(base) if sink else S.batch_folder(f"{base}/out"), mode).awaitTermination()
    return base


@query("str_events", f"SELECT event_id, event_name, session_id FROM events_v1_b WHERE {_ERROR} IS NULL", "events_v1_b")
def str_events(t):
    base = drain(t, "events", S.stream_events(stream_view(t, "events_v1_b", "events")), "append")
    return t.spark.read.parquet(f"{base}/out").select("event_id", "event_name", "session_id")


@query("str_rejects", f"SELECT {_ERROR} AS error, count(*) AS events FROM events_v1_b WHERE {_ERROR} IS NOT NULL GROUP BY 1", "events_v1_b")
def str_rejects(t):
    base = drain(t, "rejects", stream_view(t, "events_v1_b", "events"), "append", lambda b: S.split_sink(f"{b}/good", f"{b}/bad"))
    return t.spark.read.parquet(f"{base}/bad").groupBy("error").agg(F.count("*").alias("events"))


@query("str_weights", f"WITH {WEIGHTS} SELECT session_id, key, CAST(weight AS DOUBLE) AS weight FROM w", "items_b swipes_b")
def str_weights(t):
    base = drain(t, "weights", S.stream_weights(stream_view(t, "swipes_b", "events"), t.items_b, BOUNDS), "update")
    return S.latest(t.spark, f"{base}/out", ["session_id", "key"]).withColumn("weight", F.col("weight").cast("double"))


@query("str_spend", "SELECT campaign_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS impressions, count(*) * 100 AS spend_cents FROM featured_b GROUP BY 1, 2", "featured_b")
def str_spend(t):
    base = drain(t, "spend", S.stream_spend(stream_view(t, "featured_b", "lineitem")), "update")
    out = S.latest(t.spark, f"{base}/out", ["campaign_id", "day"])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("str_quality")
def str_quality(t):
    base = drain(t, "quality", S.stream_quality(stream_view(t, "deck_responses_b", "orders")), "update")
    return S.latest(t.spark, f"{base}/out", ["as_of"])


@query("str_runs", """SELECT source_id, run_id, seq, status, previous FROM (SELECT source_id, candidate_urls AS run_id, run_id AS seq, status,
      lag(status) OVER (PARTITION BY source_id, candidate_urls ORDER BY started_at, run_id) AS previous FROM runs_b) WHERE status IS DISTINCT FROM previous""", "runs_b")
def str_runs(t):
    """Several status rows of each run: the runs of the table are dealt to run ids by a column with repeats."""
    runs = stream_view(t, "runs_b", "orders").selectExpr("source_id", "candidate_urls AS run_id", "run_id AS seq", "started_at", "status")
    base = drain(t, "runs", runs, "append", S.runs_sink)
    return t.spark.read.parquet(f"{base}/out").select("source_id", "run_id", "seq", "status", "previous")


@query("str_likes", "SELECT session_id, item_id, count(*) % 2 = 1 AS liked FROM swipes_b WHERE direction = 'right' GROUP BY ALL", "swipes_b")
def str_likes(t):
    base = drain(t, "likes", S.stream_likes(stream_view(t, "swipes_b", "events").where("direction = 'right'")), "update")
    return S.latest(t.spark, f"{base}/out", ["session_id", "item_id"]).select("session_id", "item_id", "liked")
