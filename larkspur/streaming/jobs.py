"""Structured Streaming jobs over the continuously fed paths.

Sinks are idempotent: every micro-batch writes its own folder, so a batch that
runs again after a failure replaces its earlier output. Event time is the
server time; the watermark is a parameter and later rows go to the rejects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from larkspur.operators.events import validate_events
from larkspur.operators.preferences import PRICE_BOUNDS, WEIGHT, feature_keys, swipe_deltas

WATERMARK = "1 day"


def read_files(spark: SparkSession, folder: str, schema: StructType, names: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; `names` filters file names."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", names).parquet(folder))


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str) -> StreamingQuery:
    """Start a query that drains what is available; a service swaps the trigger for a schedule."""
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
            .trigger(availableNow=True).start())


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes each micro-batch to path/batch=<id>, overwriting a previous attempt."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current table of an update-mode stream: the row of the newest batch per key."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def stream_events(raw: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Valid events with a server time, the first of each id inside the watermark."""
    ok = validate_events(raw).where(F.col("error").isNull()).drop("error")
    return ok.withColumn("server_ts", F.col("ts")).withWatermark("server_ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def split_sink(good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """Two outputs of one validated micro-batch: accepted rows by day, rejected rows with their reason."""
    def write(batch: DataFrame, n: int) -> None:
        checked = validate_events(batch).persist()
        try:
            (checked.where(F.col("error").isNull()).drop("error").withColumn("dt", F.to_date("ts")).hint("rebalance", "dt")
             .write.mode("overwrite").partitionBy("dt").parquet(f"{good}/batch={n}"))
            checked.where(F.col("error").isNotNull()).write.mode("overwrite").parquet(f"{bad}/batch={n}")
        finally:
            checked.unpersist()
    return write


def stream_weights(swipes: DataFrame, items: DataFrame, bounds=PRICE_BOUNDS) -> DataFrame:
    """Running preference weights: the stream joins the item table and sums deltas per (session, key)."""
    keyed = items.select("item_id", feature_keys(items, bounds).alias("keys"))
    rows = swipes.join(keyed, "item_id").select("session_id", F.explode("keys").alias("key"), swipe_deltas(swipes).alias("delta"))
    return rows.groupBy("session_id", "key").agg(F.sum("delta").cast(WEIGHT).alias("weight"))


def stream_spend(impressions: DataFrame, cost_cents: int = 100, watermark: str = WATERMARK) -> DataFrame:
    """Impressions and spend per campaign in one-day tumbling windows."""
    return (impressions.where(F.col("campaign_id").isNotNull()).withWatermark("ts", watermark)
            .groupBy("campaign_id", F.window("ts", "1 day")).agg(F.count("*").alias("impressions"))
            .select("campaign_id", F.col("window.start").alias("day"), "impressions", (F.col("impressions") * cost_cents).alias("spend_cents")))


def stream_quality(responses: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Deck latency and slate quality over the last 24 hours, every hour (sliding window)."""
    return (responses.withWatermark("ts", watermark).groupBy(F.window("ts", "24 hours", "1 hour"))
            .agg(F.count("*").alias("responses"), F.percentile_approx("latency_ms", 0.95, 10000).alias("p95_ms"),
                 F.avg("same_family_top8_rate").alias("same_family_rate"))
            .select(F.col("window.end").alias("as_of"), "responses", "p95_ms", "same_family_rate"))


def stream_likes(toggles: DataFrame) -> DataFrame:
    """Like state per (session, item): an odd number of toggles is liked."""
    return toggles.groupBy("session_id", "item_id").agg((F.count("*") % 2 == 1).alias("liked"), F.max("ts").alias("changed_at"))


def runs_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Status changes of each run, keyed by run id, in the order of (started_at, seq) within a batch.

    A batch is compared with the last status of each run before it, which the batch before left in path/state; both
    outputs of a batch are folders of its own, so a batch that runs again replaces them. A batch's rows are later than
    the state; only the newest state folder is read.
    """
    keys = ["source_id", "run_id"]

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, "status", F.struct(F.lit(1).alias("new"), "started_at", "seq").alias("place"))
        if n:
            before = spark.read.parquet(f"{path}/state/batch={n - 1}").select(
                *keys, "status", F.struct(F.lit(0).alias("new"), F.col("started_at"), F.col("seq")).alias("place"))
            rows = before.unionByName(rows)
        rows = rows.persist()
        try:
            previous = F.lag("status").over(Window.partitionBy(*keys).orderBy("place"))
            changes = rows.withColumn("previous", previous).where((F.col("place.new") == 1) & ~F.col("status").eqNullSafe(F.col("previous")))
            changes.select(*keys, "place.started_at", "place.seq", "status", "previous").write.mode("overwrite").parquet(f"{path}/out/batch={n}")
            last = rows.groupBy(*keys).agg(F.max_by(F.struct("status", "place.started_at", "place.seq"), "place").alias("l"))
            last.select(*keys, "l.*").write.mode("overwrite").parquet(f"{path}/state/batch={n}")
        finally:
            rows.unpersist()

    return write
