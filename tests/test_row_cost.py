"""Costly row-wise work: dealt over the shuffle width, and each text worked on once per row."""
import pytest

from larkspur.operators import normalize, urls
from larkspur.plans import catalog

DIR = "/root/testdata/sf0.001"


def analyzed(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["cls_url_type", "flt_product_candidates", "url_rank_candidates", "nrm_style_tags", "nrm_finalize_items",
                                  "nrm_feed_item", "nrm_hygiene_backfill", "agg_onboarding_weights"])
def test_rows_are_dealt_before_they_are_worked_on(spark, name):
    assert "RepartitionByExpression" in analyzed(catalog.callables()[name](spark, DIR))


def test_product_weights_are_summed_once(spark):
    plan = analyzed(urls.with_url_type(spark.createDataFrame([("https://e.com/p/a",)], "url string")))
    assert plan.count("/p-[a-z]") == 1


def test_tag_texts_are_joined_once(spark):
    items = spark.createDataFrame([("Sofa", "Modern")], "title string, description string")
    plan = analyzed(normalize.derive_tags(items).select("style_tags", "eco_tags"))
    assert plan.count("[^a-z0-9åäö]+") == 2


def test_feed_price_is_parsed_once(spark):
    raw = spark.createDataFrame([("Sofa", "1 990 kr", "https://e.com/p/a")], "title string, price string, url string")
    mapped = normalize.map_feed_columns(raw)
    plan = analyzed(normalize.normalize_feed(mapped, mapped["url"]).select("price_amount"))
    assert plan.count("[.,]+$") == 1


def test_hygiene_price_is_parsed_once_a_candidate(spark):
    rows = spark.createDataFrame([("1", "Sofa", None, "1 990 kr", None, "SEK")],
                                 "id string, title string, description string, price_amount string, price_original string, price_currency string")
    plan = analyzed(normalize.hygiene_changes(rows).select("new_price", "reasons"))
    assert plan.count("[.,]+$") == 2
