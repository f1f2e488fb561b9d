"""Sinks: merge-upsert, idempotent event tables, snapshots and dated metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import materialize


def _storable(df: DataFrame, c: str) -> Column:
    """NaN and infinities are stored as null."""
    if dict(df.dtypes)[c] in ("double", "float"):
        return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)).alias(c)
    return F.col(c)


def upsert(target: DataFrame, updates: DataFrame, key: str, now: Column, timestamps: tuple[str, ...] = ()) -> DataFrame:
    """Next version of a table: update fields win where present, absent fields keep their value.

    Missing timestamps of updated rows become `now`. Keys are unique on both
    sides; with both tables bucketed on the key the join needs no shuffle.
    """
    cols = [c for c in target.columns if c != key]
    clean = updates.select(key, *[
        (F.coalesce(F.col(c), now).alias(c) if c in timestamps else _storable(updates, c))
        for c in updates.columns if c != key])
    joined = target.alias("t").join(clean.alias("u"), key, "full")
    present = set(updates.columns)
    return joined.select(key, *[
        F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")).alias(c) if c in present else F.col(f"t.{c}") for c in cols])


def merge_events(events: DataFrame, key: str = "event_id", arrival: str = "arrival", keep_arrival: bool = False) -> DataFrame:
    """One row per event id; for every field the latest non-null value wins."""
    fields = [c for c in events.columns if c not in (key, arrival)]
    last = [F.max(arrival).alias(arrival)] if keep_arrival else []
    return events.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c) for c in fields], *last)


def _stored_days(df: DataFrame, path: str) -> DataFrame | None:
    """Rows of a dated table for the days that df touches; None where the table does not exist yet."""
    spark = df.sparkSession
    if not _exists(spark, path):
        return None
    # an equi join on the partition column prunes the days at run time
    return spark.read.schema(df.schema).parquet(path).join(df.select("dt").distinct(), "dt", "left_semi").select(*df.columns)


def _replace_days(df: DataFrame, path: str) -> None:
    """Writes the merged days back. They are staged first, as a job cannot overwrite what it reads."""
    staged = materialize(df, "days")
    (staged.hint("rebalance", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dt").parquet(path))


def write_events(events: DataFrame, path: str, key: str = "event_id", arrival: str = "arrival", ts: str = "ts") -> None:
    """Keyed merge into an event table partitioned by day; only touched days are read and written.

    An event id keeps its day (`ts` is the client's and does not change when an event is sent again). `arrival` stays
    in the table, so later batches can be compared. Rebalancing splits a heavy day over several files.
    """
    dated = events.withColumn("dt", F.to_date(ts))
    stored = _stored_days(dated, path)
    both = dated if stored is None else stored.unionByName(dated)
    _replace_days(merge_events(both, key, arrival, keep_arrival=True), path)


def snapshot_hash(columns: list[str]) -> Column:
    """SHA-256 of the JSON of the named columns in sorted key order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_snapshots(df: DataFrame, columns: list[str], path: str, key: str) -> None:
    """Adds a snapshot of each row whose hash its key does not bear yet; what is stored is read by key and hash alone."""
    rows = df.withColumn("snapshot_json", F.to_json(F.struct(*sorted(columns)))).withColumn("hash", F.sha2("snapshot_json", 256))
    if _exists(df.sparkSession, path):
        stored = df.sparkSession.read.schema(rows.schema).parquet(path).select(key, "hash")
        rows = materialize(rows.join(stored, [key, "hash"], "left_anti").select(*rows.columns), "snapshots")
    rows.write.mode("append").parquet(path)


def upsert_metrics(current: DataFrame, new: DataFrame) -> DataFrame:
    """Metric rows by (source_id, dt): fields of the new rows win."""
    metrics = [c for c in current.columns if c not in ("source_id", "dt")]
    joined = current.alias("c").join(new.alias("n"), ["source_id", "dt"], "full")
    return joined.select("source_id", "dt", *[F.coalesce(f"n.{m}", f"c.{m}").alias(m) for m in metrics])


def write_metrics(df: DataFrame, path: str) -> None:
    """Keyed merge by (source_id, dt) into a table partitioned by day; only touched days are read and written."""
    stored = _stored_days(df, path)
    _replace_days(df if stored is None else upsert_metrics(stored, df).select(*df.columns), path)


def write_csv_report(report: DataFrame, path: str) -> None:
    """Report rows (already aggregated) as CSV with a header and quoted text."""
    report.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


EVENT_DAYS, SNAPSHOT_DAYS, FAILURE_DAYS = 730, 30, 7


def retain(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows inside the retention period; on a dated table this prunes partitions."""
    return df.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))
