"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the links (a, b); root is the smallest vertex it can reach.

    Each step points vertices at smaller neighbours, so the number of steps grows with the logarithm of the longest
    chain. Steps are aggregates and joins; no neighbourhood is collected, and a hub's rows can be split. Every step is
    written to the shared folder, which cuts the lineage.
    """
    edges = c.materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).where(F.col("v") != F.col("root")).distinct(), "edges")
    before = None
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("root").alias("n")).union(edges.select(F.col("root"), F.col("v")))
        low = both.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("n") > F.col("u")).select(F.col("n").alias("v"), F.col("m").alias("root")).distinct()
        large = large.where(F.col("v") != F.col("root"))
        least = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(least, "v")
        edges = c.materialize(small.where(F.col("root") != F.col("m")).select(F.col("root").alias("v"), F.col("m").alias("root"))
                              .union(least.select("v", F.col("m").alias("root"))).distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges
        before = tuple(state)
