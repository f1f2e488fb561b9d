"""The deck job looks only at segments that offers of its pool ask for, and its slates stay as with all matches."""

import dataclasses

from larkspur.plans import decks as D
from larkspur.plans import q_decks as Q
from larkspur.sources.bindings import Tables

SF_DIR = "/root/testdata/sf0.001"


def test_only_segments_of_the_pool_are_matched(spark, monkeypatch):
    t = Tables(spark, SF_DIR)
    offers = Q.offered(t).selectExpr("item_id", "offer.segment_id").where("segment_id IS NOT NULL").collect()
    monkeypatch.setattr(Q, "OPTIONS", dataclasses.replace(Q.OPTIONS, pool=3))
    match, build, seen = Q.T.match_segments, D.build_slates, {}

    def spy(profiles, segments):
        seen["segments"] = {r.segment_id for r in segments.select("segment_id").collect()}
        return match(profiles, segments)

    monkeypatch.setattr(Q.T, "match_segments", spy)
    few = {r.session_id: r.rows for r in Q.slates(t).collect()}
    assert seen["segments"] and seen["segments"] < {r.segment_id for r in offers} and len(seen["segments"]) <= 6
    every = match(Q.profiles(t), Q.segments(t)).select("session_id", "segment_id")
    monkeypatch.setattr(D, "build_slates", lambda *args: build(*args[:6], every, *args[7:]))
    assert few == {r.session_id: r.rows for r in Q.slates(t).collect()} and any(few.values())


def test_offers_take_repeated_products(spark):
    """A product listed twice makes one offer; restricted campaigns that list no product at all offer every item."""
    promoted = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30), (5, None)], "item_id long, campaign_id long")
    campaigns = spark.createDataFrame([(10, 100, "selected"), (20, 200, "auto"), (30, 300, "all")], "campaign_id long, segment_id long, product_mode string")
    products = spark.createDataFrame([(10, 1), (10, 1), (30, 9)], "campaign_id long, item_id long")
    got = sorted((r.item_id, r.offer.segment_id) for r in D.offers(promoted, campaigns, products).collect())
    assert got == [(1, 100), (3, 200), (4, 300), (5, None)]
