"""Ranking, shaping and targeting against brute force and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import preferences as P
from larkspur.operators import ranking as R
from larkspur.operators import shaping as S
from larkspur.operators import targeting as T
from larkspur.operators.scoring import top_profiles


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(7)
    items = [(i, [rng.choice("abc"), rng.choice("xyz")], rng.choice(["fabric", "wood", None]), float(rng.choice([1000, 5000, 20000]))) for i in range(120)]
    weights = [(s, k, round(rng.uniform(-2, 3), 2)) for s in range(15) for k in ["a", "b", "x", "y", "material:wood", "price_bucket:mid", "price_bucket:budget"]
               if rng.random() < 0.7]
    i = spark.createDataFrame(items, "item_id long, style_tags array<string>, material string, price_amount double").withColumn("is_active", F.lit(True))
    w = spark.createDataFrame(weights, "session_id long, key string, weight double").withColumn("weight", F.col("weight").cast(P.WEIGHT))
    return i, w, items, weights


def brute_topk(items, weights, k):
    by = {}
    for s, key, v in weights:
        by.setdefault(s, {})[key] = v
    out = {}
    for s, ws in by.items():
        rows = []
        for i, tags, mat, price in items:
            keys = list(tags) + ([f"material:{mat}"] if mat else []) + ["price_bucket:" + ("budget" if price <= 3000 else "affordable" if price <= 8000 else "premium")]
            hits = [ws[x] for x in keys if ws.get(x)]
            if hits:
                rows.append((-(round(sum(hits), 2) / np.sqrt(len(hits))), i))
        out[s] = [i for _, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("bound", [200_000, 0])
def test_preference_topk_matches_brute_force(catalog, bound):
    """Both plans: broadcast block scoring, and the keyed join beyond the size bound."""
    items, weights, raw_items, raw_weights = catalog
    got = {}
    for r in R.preference_topk(weights, items, 10, max_profiles=bound).orderBy("session_id", "rank").collect():
        got.setdefault(r.session_id, []).append(r.item_id)
    assert got == brute_topk(raw_items, raw_weights, 10)


def test_large_catalogs_make_no_row_of_a_session_and_a_profile(catalog):
    """Beyond the size of a block too, weights never meet profile keys in a join."""
    items, weights, _, _ = catalog
    for out in (R.preference_topk(weights, items, 10, max_profiles=0), R.overlap_histogram(P.top_keys(weights), items, max_profiles=0)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" in plan and not [line for line in plan.splitlines() if "Join" in line and "(key#" in line]


def test_profiles_offer_what_better_ones_leave(spark):
    """Copies of a profile: a session lists at most k rows before the final cut, not k items of each of k profiles."""
    items = spark.range(400).select(F.col("id").alias("item_id"), F.array((F.col("id") % 20).cast("string")).alias("style_tags"))
    weights = spark.range(20).select(F.lit(1).alias("session_id"), F.col("id").cast("string").alias("key"), (F.col("id") + 1).cast(P.WEIGHT).alias("weight"))
    kept = top_profiles(weights, P.item_profiles(items), 20).collect()
    assert [(r.first_item, r.needed) for r in kept] == [(19, 20)]
    got = R.preference_topk(weights, items, 30).orderBy("rank").collect()
    assert [r.item_id for r in got] == [*range(19, 400, 20), *range(18, 200, 20)]


def test_overlap_plans_agree(catalog):
    items, weights, _, _ = catalog
    top = P.top_keys(weights)
    rows = lambda b: sorted(map(tuple, R.overlap_histogram(top, items, max_profiles=b).collect()))
    assert rows(200_000) == rows(0)


@pytest.mark.parametrize("normalize,positive_only", [(True, False), (False, True), (False, False)])
def test_bounded_search_equals_a_full_scan(normalize, positive_only):
    """Most first halves are left out by their bound, and ties at the k-th score still go to the smaller profile."""
    import pyarrow as pa
    from larkspur.operators import scoring
    rng = np.random.default_rng(3)
    keys = sorted({tuple(sorted({f"{c}{rng.integers(6)}" for c in "abcdef" if rng.random() < 0.9})) for _ in range(20_000)})
    table = scoring._table(pa.table({"keys": pa.array(map(list, keys), pa.list_(pa.string())), "first_item": rng.permutation(len(keys)), "items": np.ones(len(keys), np.int64)}))
    assert len(table.sizes) < len(keys)
    for k in (1, 20, 300):
        cents = {f"{c}{i}": float(rng.integers(-3, 4) * 35) for c in "abcdef" for i in range(5)}
        w = scoring._matrix(table, [list(cents)], [list(cents.values())])
        w[w != 0] += scoring.HIT
        left, right = (part[0] for part in scoring._parts(table, w))
        firsts = np.repeat(np.arange(len(table.sizes)), table.sizes)
        sums, hits = scoring._split(left[firsts] + right[table.second])
        every = np.full(len(keys), -np.inf)
        every[table.names] = scoring._scores(sums, hits, normalize, positive_only)
        want = [i for i in np.lexsort((np.arange(len(keys)), -every))[:k] if every[i] > -np.inf]
        scores, profiles, matches = scoring._winners(table, left, right, k, normalize, positive_only)
        assert profiles.tolist() == want and scores.tolist() == every[want].tolist() and matches.min() > 0


@pytest.mark.parametrize("cap,window", [(2, 5), (1, 12), (6, 3)])
def test_native_key_cap_equals_the_scan(spark, cap, window):
    rng = random.Random(cap * 10 + window)
    keys = [rng.choice(["a", "b", "c", None]) for _ in range(40)]
    df = spark.createDataFrame([(1, i, i + 1, k) for i, k in enumerate(keys)], "session_id int, item_id int, rank int, k string")
    got = [r.item_id for r in R.key_cap(df, "k", cap, window).orderBy("position").collect()]
    rows = df.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "k"))).alias("rows"))
    assert got == [r.item_id for r in rows.select(S.cap_keys(F.col("rows"), "k", cap, window, 0).alias("rows")).first().rows]


def test_exploration_is_seeded_and_sized(spark):
    df = spark.createDataFrame([(s, i, i + 1) for s in range(5) for i in range(40)], "session_id int, item_id int, rank int")
    run = lambda seed: sorted(map(tuple, R.explore(df, F.lit(0.25), 20, seed).collect()))
    a = run(1)
    assert a == run(1) and a != run(2)
    for s in range(5):
        rows = [r for r in a if r[0] == s]
        assert sorted(r[2] for r in rows) == list(range(1, 21)) and sum(r[3] for r in rows) == 5


def test_queue_quota_fills_the_cap():
    for cap in (1, 7, 40, 240):
        for pref in (True, False):
            for persona in (True, False):
                q = R.queue_quota(cap, pref, persona)
                assert sum(q.values()) >= cap and (cap < 6 or sum(q.values()) == cap)
                assert persona or q["persona_similar"] == 0


def test_segment_match_equals_nested_loop(spark):
    rng = random.Random(5)
    pick = lambda xs, n: rng.sample(xs, rng.randint(0, n))
    crit = lambda i: (i, pick(["modern", "classic", "boho"], 2), pick(["small", "large"], 1), rng.choice([None, 100.0, 500.0]), rng.choice([None, 800.0]), rng.choice([None, "sweden", "norway"]))
    fields = "style_tags array<string>, size_classes array<string>, budget_min double, budget_max double, geo_region string"
    p = spark.createDataFrame([crit(i) for i in range(40)], f"session_id int, {fields}")
    s = spark.createDataFrame([crit(i) for i in range(30)], f"segment_id int, {fields}")
    got = {tuple(r) for r in T.match_segments(p, s).collect()}
    assert got == {tuple(r) for r in T.match_segments(p, s, hot_rows=3, salts=4).collect()}
    pairs = p.select("session_id", F.struct(*T.PROFILE_FIELDS).alias("p")).crossJoin(s.select("segment_id", F.struct(*T.PROFILE_FIELDS).alias("s")))
    want = pairs.withColumns(T.match_columns()).where("all_required AND match_score >= 0.5").select("session_id", "segment_id", "match_score")
    assert got == {tuple(r) for r in want.collect()} and got


def test_given_pairs_match_as_in_the_whole_join(spark):
    """Of given pairs those of the whole join are found, and a pair that is not asked for is not."""
    crit = lambda i: (i, ["a", "b"][i % 2:], ["small"][: i % 3], None, [None, 5.0 + i][i % 2], ["north", None][i % 2])
    fields = "style_tags array<string>, size_classes array<string>, budget_min double, budget_max double, geo_region string"
    p = spark.createDataFrame([crit(i) for i in range(12)], f"session_id int, {fields}")
    s = spark.createDataFrame([crit(i) for i in range(12)], f"segment_id int, {fields}")
    asked = spark.createDataFrame([(i, j) for i in range(12) for j in range(12) if (i + j) % 3] + [(99, 1), (1, None)], "session_id int, segment_id int")
    want = {tuple(r) for r in T.match_segments(p, s).collect() if (r.session_id + r.segment_id) % 3}
    assert {tuple(r) for r in T.match_pairs(asked, p, s).collect()} == want and want


def test_no_pair_of_a_region_is_formed(spark):
    """Nine in ten profiles and segments share a region: the join's rows are those that agree in all they ask for."""
    p = spark.range(2000).select(F.col("id").alias("session_id"), F.array(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("style_tags"), F.array(F.lit("small")).alias("size_classes"),
                                 F.lit(0.0).alias("budget_min"), F.lit(9.0).alias("budget_max"), F.when(F.col("id") % 10 > 0, "north").otherwise("south").alias("geo_region"))
    s = p.where("session_id < 200").withColumnRenamed("session_id", "segment_id").withColumn("budget_min", F.when(F.col("segment_id") % 2 == 0, 5.0).otherwise(50.0)).withColumn("budget_max", F.lit(None).cast("double"))
    out = T.match_segments(p, s, hot_rows=100)
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    want = p.join(s, (p.geo_region == s.geo_region) & (p.style_tags == s.style_tags) & (s.budget_min < 10)).count()
    assert out.count() == want and want < 2000 * 200 / 40


@pytest.mark.parametrize("hot", [False, True])
def test_overlap_counts_equal_a_nested_loop(spark, hot):
    rng = random.Random(9)
    bound = lambda: rng.choice([None, *map(float, range(0, 12))])
    region = lambda: "a" if hot and rng.random() < 0.9 else rng.choice(["a", "b", "c", None])
    p = [(i, region(), bound(), bound()) for i in range(300)]
    s = [(region(), bound(), bound()) for _ in range(200)]
    inf = float("inf")
    lo, hi = (lambda x: -inf if x is None else x), (lambda x: inf if x is None else x)
    want = {i: n for i, r, a, b in p if (n := sum(r is not None and r == q and max(lo(a), lo(c)) <= min(hi(b), hi(d)) and lo(c) <= hi(d) and lo(a) <= hi(b) for q, c, d in s))}
    got = T.overlap_counts(spark.createDataFrame(p, "session_id int, geo_region string, budget_min double, budget_max double"),
                           spark.createDataFrame(s, "geo_region string, budget_min double, budget_max double"))
    assert {r.session_id: r.overlapping for r in got.collect()} == want


def test_segment_criteria_issues(spark):
    df = spark.createDataFrame([(1, ["Modern", "modern", " "], ["small", "unknown"], 9000.0, 5000.0, "SE", ["114 52", "#bad"])],
                               "segment_id int, style_tags array<string>, size_classes array<string>, budget_min double, budget_max double, geo_region string, geo_postcodes array<string>")
    r = T.normalize_criteria(df).first()
    assert r.style_tags == ["modern"] and r.geo_region == "sweden" and r.geo_postcodes == ["11452"]
    assert {i.split(":")[0] for i in r.issues} == {"sizeClasses", "geoPostcodes", "budgetMin/budgetMax"}


def test_study_reranks_once(spark):
    """Slates are written once and read by what follows, so the re-ranking is not part of the returned plan."""
    from larkspur.plans.q_decks import evl_ranking_study
    from larkspur.sources.bindings import Tables
    files = evl_ranking_study(Tables(spark, "/root/testdata/sf0.001")).inputFiles()
    assert any("study_slates" in f for f in files) and not any("study_base" in f for f in files)
