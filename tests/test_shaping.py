"""Shaping rules on slates as arrays: what each rule promises, and the deck's gates and fallbacks."""

import collections
import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import shaping as S
from larkspur.plans import decks as D
from larkspur.plans import q_decks as Q
from larkspur.sources.bindings import Tables

FIELDS = "item_id:long,score:double,canonical_url:string,family_key:string,model_key:string,variant_key:string,source_key:string,quality_ok:boolean,tokens:array<string>,featured:boolean,retailer:string"


@pytest.fixture(scope="module")
def slates(spark):
    rng = random.Random(3)
    data = []
    for s in range(60):
        rows = []
        for i in range(rng.randint(0, 40)):
            m = rng.choice(["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", None])
            rows.append((i, round(1 - i / 50, 3), rng.choice([None, "u1", f"x{i}"]), m and f"r{rng.randint(0, 2)}::{m}", m, m and f"{m}::{rng.randint(0, 3)}", rng.choice([None, "1", "2", "3"]),
                         rng.random() < 0.7, [t for t in "abcdef" if rng.random() < 0.4], rng.random() < 0.3, rng.choice([None, "q", "w", "e"])))
        data.append((s, rows))
    return spark.createDataFrame(data, f"session_id long, rows array<struct<{FIELDS}>>").repartition(4).cache()


def apply(slates, rule):
    before = {r.session_id: r.rows for r in slates.collect()}
    return [(before[r.session_id], r.rows) for r in S.reorder(slates, rule).collect()]


def test_rules_that_reorder_lose_nothing(slates):
    o = S.ShapeOptions()
    for rule in (lambda r: S.near_duplicates(r, o), lambda r: S.cap_keys(r, "source_key", 2, 12, 20), lambda r: S.mmr(r, 0.7, 25), lambda r: S.mmr(r, 1.0, 25)):
        assert all(sorted(x.item_id for x in a) == sorted(x.item_id for x in b) for a, b in apply(slates, rule))


def test_near_duplicates_keep_the_head_unique(slates):
    for before, after in apply(slates, lambda r: S.near_duplicates(r, S.ShapeOptions())):
        if len({x.model_key for x in before if x.model_key}) >= 8:
            models = collections.Counter(x.model_key for x in after[:8] if x.model_key)
            assert max(models.values(), default=0) <= 1


def test_featured_rows_keep_their_places(slates):
    for before, after in apply(slates, lambda r: S.featured_slots(r, 20, 5, 1)):
        spots = [p for p, x in enumerate(after, 1) if x.featured]
        assert len(after) <= 20 and len({x.item_id for x in after}) == len(after) and all(p % 5 == 0 for p in spots)
        owners = [x.retailer for x in after if x.featured]
        assert all(a is None or a != b for a, b in zip(owners, owners[1:]))


def test_mmr_needs_no_more_than_is_read(slates):
    whole, part = (apply(slates, lambda r, n=n: S.mmr(r, 0.6, 30, n)) for n in (None, 7))
    assert [[x.item_id for x in b[:7]] for _, b in whole] == [[x.item_id for x in b] for _, b in part]


def test_accepted_rows_are_new(slates):
    for _, after in apply(slates, lambda r: S.accept(r, 15)):
        urls = [x.canonical_url for x in after if x.canonical_url]
        families = [x.family_key for x in after[:12] if x.family_key]
        assert len(after) <= 15 and len(set(urls)) == len(urls) and len(set(families)) == len(families)


def test_decks(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    out = Q.slates(t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = out.collect()
    assert len(rows) == t.deck_sessions_b.count() and all(len(r.rows) <= 20 for r in rows)
    items = {r.item_id: r for r in t.deck_items_b.collect()}
    for r in rows:
        assert len({x.item_id for x in r.rows}) == len(r.rows)
        shown = [items[x.item_id] for x in r.rows]
        assert all(i.is_active and i.image_count > 0 and i.catalog_included is not False for i in shown)
        assert not any("soffbord" in i.title for x, i in zip(r.rows, shown) if not x.featured)


def test_a_session_that_saw_everything_gets_it_again(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    one = t.deck_sessions_b.where("session_id = 1").select("session_id", "pick_hash", "onboarded", *[F.lit(None).cast(k).alias(c) for c, k in (
        ("want_size_class", "string"), ("want_color_family", "string"), ("want_seat_bucket", "string"), ("modular_only", "boolean"), ("want_small_space", "boolean"), ("budget_min", "double"), ("budget_max", "double"))])
    none = spark.createDataFrame([], "session_id long, segment_id long")
    weights = spark.createDataFrame([(1, "material:wood", 2.0)], "session_id long, key string, weight double").withColumn("weight", F.col("weight").cast("decimal(12,2)"))
    cohorts = spark.createDataFrame([], "pick_hash long, item_id long, normalized_score double, rank int")
    swipes = t.items_b.select(F.lit(1).cast("long").alias("session_id"), "item_id", F.current_timestamp().alias("ts"))
    def deck(seen, **options):
        return D.build_slates(one, weights, t.deck_items_b, Q.offered(t), seen, cohorts, none, F.current_timestamp(), None, Q.BOUNDS, dataclasses.replace(Q.OPTIONS, **options)).first()
    assert deck(swipes).fallback == "recycled_seen_items" and deck(swipes).rows
    assert deck(swipes.where("item_id % 2 = 0")).fallback == "none"
    assert all(x.item_id % 2 for x in deck(swipes.where("item_id % 2 = 0")).rows)
    cut = {r.item_id for r in t.deck_items_b.where("scene_type = 'studio_cutout'").collect()}
    few = deck(swipes.limit(0), cap=20, exploration=0.0)
    assert few.rows and not any(x.item_id in cut for x in few.rows)
