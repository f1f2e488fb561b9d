"""Staging of expensive row-wise values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Adjacent projections are merged by the optimizer, which re-evaluates an
    expensive value inside every lambda or filter that mentions it. A one-row
    generator is a boundary that keeps the value computed once; it adds no
    shuffle and keeps column pruning.
    """
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash layout on the keys over the session's full shuffle width.

    Adaptive execution merges small partitions by bytes; rows that are small
    but expensive to process would then share one core. An explicit width keeps
    them spread, and grouping or ranking on the keys needs no further shuffle.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows dealt over the full shuffle width by all their columns.

    A table of few bytes and many rows is read by few tasks; rows that are
    costly to process are dealt before that, so that every core has a share.
    """
    return by_key(df, *df.columns)
