"""Segment match by kinds: where kinds are few, a pair of rows costs comparisons of budgets only, and the result is that of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import targeting as T

FIELDS = "style_tags array<string>, size_classes array<string>, budget_min double, budget_max double, geo_region string"


def _rows(spark, own: str, n: int, seed: int):
    rng = random.Random(seed)
    pick = lambda xs, k: rng.sample(xs, rng.randint(0, k))
    crit = lambda i: (i, pick(["modern", "boho"], 2), pick(["small"], 1), rng.choice([None, 100.0, 500.0, 900.0]), rng.choice([None, 300.0, 800.0, float("nan")]), rng.choice([None, "sweden"]))
    return spark.createDataFrame([crit(i) for i in range(n)], f"{own} int, {FIELDS}")


@pytest.mark.parametrize("n_profiles,n_segments,pairs", [(900, 300, 1 << 16), (300, 900, 1 << 16), (700, 300, 500)])
def test_kinds_give_all_pairs(spark, monkeypatch, n_profiles, n_segments, pairs):
    """Missing, crossed and NaN bounds, either side repeated, one and many salts."""
    monkeypatch.setattr(T, "GROUP_PAIRS", pairs)
    p, s = _rows(spark, "session_id", n_profiles, 1), _rows(spark, "segment_id", n_segments, 2)
    out = T.match_segments(p, s)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = [tuple(r) for r in out.collect()]
    both = p.select("session_id", F.struct(*T.PROFILE_FIELDS).alias("p")).crossJoin(s.select("segment_id", F.struct(*T.PROFILE_FIELDS).alias("s")))
    want = both.withColumns(T.match_columns()).where("all_required AND match_score >= 0.5").select("session_id", "segment_id", "match_score")
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and got


def test_nothing_to_match(spark):
    p, s = _rows(spark, "session_id", 50, 1), _rows(spark, "segment_id", 50, 2)
    assert T.match_segments(p.limit(0), s).count() == 0 and T.match_segments(p, s.limit(0)).count() == 0
