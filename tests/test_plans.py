"""Plan checks: no nested-loop joins, Python only where a query needs it, filters in the scan."""

import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
NATIVE = ["agg_confidence_score", "agg_preference_weights", "agg_persona_signals", "nrm_finalize_items", "cls_category_scores", "rpt_campaign",
          "jn_segment_match", "evl_liked_in_topk", "win_drift", "rnk_quota_merge", "cls_url_type", "snk_events_dedup", "jn_stale_items", "cmp_promoted_decision"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plan(spark, name):
    text = plan(entry_module.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(entry_module.queries()["src_items_by_ids"](spark, SF_DIR))
    assert "PushedFilters: [In(p_partkey" in text and "p_size" not in text.split("ReadSchema")[1]
