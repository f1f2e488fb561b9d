"""Classification, pacing, extraction, events and streaming on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from larkspur.functions.dom import page_facts
from larkspur.operators import campaigns as C
from larkspur.operators import classify as K
from larkspur.operators import confidence as S
from larkspur.operators import events as E
from larkspur.operators import extract as X
from larkspur.operators import lookups as J
from larkspur.operators import review as R
from larkspur.sources import sinks
from larkspur.streaming.jobs import latest, runs_sink


def test_classifier_default_lexicons(spark):
    rows = [(1, "Bolero 3-sits soffa", "Hem Soffor", ""), (2, "Soffbord ek", "Bord", ""), (3, "Random", "", ""), (4, "Fåtölj Lilly", "", "en karmstol")]
    df = spark.createDataFrame(rows, "item_id int, title string, breadcrumb_text string, description string")
    top = {r.item_id: r.primary_category for r in K.top_categories(K.score_categories(K.build_evidence(df))).collect()}
    assert top == {1: "sofa", 2: "coffee_table", 3: "unknown", 4: "armchair"}


def test_profile_axes(spark):
    df = spark.createDataFrame([(1, "divansoffa 3-sits för vardagsrum"), (2, "bäddsoffa"), (3, "utesoffa till altan och vardagsrum")], "item_id int, profile_text string").withColumn("primary_category", F.lit("sofa"))
    r = {x.item_id: x for x in K.derive_profile(df).collect()}
    assert (r[1].sofa_shape, r[1].seat_bucket, r[1].sub_category, r[1].environment) == ("chaise", "3", "chaise_sofa", "indoor")
    assert r[2].sub_category == "sleeper_sofa" and r[3].environment == "both"


def test_calibration_prefers_lowest_threshold_on_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False), (0.1, False)], "confidence double, correct boolean")
    r = R.calibrate(df).first()
    assert r.accept_threshold == 0.3 and r.best_f1 == 1.0 and r.reject_threshold == 0.1


def test_pacing_conserves_budget(spark):
    d = dt.date
    df = spark.createDataFrame([(1, 3001, d(2026, 3, 1), d(2026, 3, 2)), (2, 10000, d(2026, 3, 1), d(2026, 3, 5)), (3, 0, d(2026, 3, 1), d(2026, 3, 3)), (4, 100, d(2026, 3, 5), d(2026, 3, 1)), (5, 7, d(2026, 1, 1), d(2026, 3, 31))],
                               "campaign_id int, budget_cents long, start_date date, end_date date")
    for strategy in ("even", "frontload", "backload"):
        rows = C.pacing_daily(df, strategy).orderBy("campaign_id", "day").collect()
        total = {}
        for r in rows:
            assert r.cents >= 0
            total[r.campaign_id] = total.get(r.campaign_id, 0) + r.cents
        assert total == {1: 3001, 2: 10000, 5: 7}
    even = [r.cents for r in C.pacing_daily(df.where("campaign_id = 1"), "even").orderBy("day").collect()]
    assert even == [1501, 1500]
    hours = C.pacing_hourly(df.selectExpr("campaign_id", "budget_cents AS budget_daily_cents"), "backload")
    assert {r.campaign_id: r.s for r in hours.groupBy("campaign_id").agg(F.sum("cents").alias("s")).collect()} == {1: 3001, 2: 10000, 4: 100, 5: 7}


def test_html_facts():
    html = """<h1>Soffa Ö</h1><dl><dt>Vikt</dt><dd>40 kg</dd></dl><table><tr><th>Höjd</th><td>85 cm</td></tr></table>
      <ul><li>Klädsel: Sammet</li></ul><span class="price">12 995 kr</span><img src="/a.jpg"><script>var p = "<p>no</p>"</script>"""
    f = page_facts(html)
    assert f["title"] == "Soffa Ö" and f["price_raw"] == "12 995 kr" and f["images"] == ["/a.jpg"]
    assert [(p["key"], p["value"]) for p in f["pairs"]] == [("Vikt", "40 kg"), ("Höjd", "85 cm"), ("Klädsel", "Sammet")]


def test_extraction_cascade_order(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","name":"LD soffa","url":"https://x.se/p/ld","image":"https://x.se/a.jpg","offers":{"price":"4995","priceCurrency":"EUR"}}</script>'
    state = '<script id="__NEXT_DATA__" type="application/json">{"a":[{"b":{"name":"State stol","price":700,"sku":"1"}}]}</script>'
    dom = '<h1>Dom bord</h1><span class="price">900 kr</span>'
    pages = spark.createDataFrame([(1, "https://x.se/1", ld + state + dom), (2, "https://x.se/2", state + dom), (3, "https://x.se/3", dom), (4, "https://x.se/4", "<p>none</p>")], "page_id int, url string, html string")
    got = {r.page_id: r for r in X.extract_products(pages).collect()}
    assert {k: (r.method, r.title, r.price_amount) for k, r in got.items()} == {
        1: ("jsonld", "LD soffa", 4995.0), 2: ("embedded_json", "State stol", 700.0), 3: ("dom", "Dom bord", 900.0)}
    assert got[1].price_currency == "EUR" and got[1].canonical_url == "https://x.se/p/ld"


def test_sequence_check_spans_days(spark):
    t = dt.datetime
    rows = [("a", 1, 1, t(2024, 1, 1, 1)), ("b", 1, 2, t(2024, 1, 1, 2)), ("c", 1, 2, t(2024, 1, 3, 1)), ("d", 1, 9, t(2024, 1, 3, 2)), ("e", 1, 8, t(2024, 1, 3, 3)), ("f", 2, 1, t(2024, 1, 3, 3))]
    df = spark.createDataFrame(rows, "event_id string, session_id int, client_seq int, ts timestamp")
    assert sorted(r.event_id for r in E.sequence_violations(df).collect()) == ["c", "e"]


def test_recycle_returns_everything_only_for_exhausted_sessions(spark):
    cand = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "session_id int, item_id int")
    fresh = spark.createDataFrame([(1, 2)], "session_id int, item_id int")
    assert sorted(map(tuple, J.recycle(cand, fresh).collect())) == [(1, 2, False), (2, 1, True)]


def test_merge_keeps_latest_non_null_field(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0), (1, None, 2.0, 1), (2, "b", None, 0)], "event_id int, name string, v double, arrival int")
    assert sorted(map(tuple, sinks.merge_events(df).collect())) == [(1, "a", 2.0), (2, "b", None)]


def test_event_names_feed_counts(spark):
    df = S.map_event_types(spark.createDataFrame([("swipe_right",), ("outbound_click",), ("swipe_left",), ("impression",)], "event_type string"))
    assert [tuple(r)[1:] for r in df.collect()] == [(False, True, False, False), (False, False, True, False), (False, False, False, True), (True, False, False, False)]


def test_metrics_table_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "m")
    a = spark.createDataFrame([("s", "2024-01-01", 1.0), ("s", "2024-01-02", 2.0)], "source_id string, dt string, v double")
    sinks.write_metrics(a, path)
    sinks.write_metrics(a.where("dt = '2024-01-02'").withColumn("v", F.lit(9.0)), path)
    sinks.write_metrics(a.where("dt = '2024-01-02'").withColumns({"source_id": F.lit("t"), "v": F.lit(5.0)}), path)
    assert {(r.source_id, str(r.dt)): r.v for r in spark.read.parquet(path).collect()} == {("s", "2024-01-01"): 1.0, ("s", "2024-01-02"): 9.0, ("t", "2024-01-02"): 5.0}


def test_event_table_keeps_earlier_batches(spark, tmp_path):
    path = str(tmp_path / "e")
    def batch(*rows):
        return spark.createDataFrame([(*r[:3], dt.datetime(2024, 1, r[3], 12), r[4]) for r in rows], "event_id string, name string, v double, ts timestamp, arrival long")
    sinks.write_events(batch(("a", "x", 1.0, 1, 1), ("c", "z", 3.0, 2, 1)), path)
    sinks.write_events(batch(("b", "y", None, 1, 2), ("a", None, 7.0, 1, 2)), path)
    got = {r.event_id: (r["name"], r.v, str(r.dt)) for r in spark.read.parquet(path).collect()}
    assert got == {"a": ("x", 7.0, "2024-01-01"), "b": ("y", None, "2024-01-01"), "c": ("z", 3.0, "2024-01-02")}


def test_latest_batch_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    for n, v in ((0, 1), (1, 5)):
        spark.createDataFrame([("k", v)], "key string, v int").write.parquet(f"{path}/batch={n}")
    assert [tuple(r) for r in latest(spark, path, ["key"]).collect()] == [("k", 5)]


def test_run_changes_go_on_over_batches(spark, tmp_path):
    write = runs_sink(str(tmp_path))
    def batch(*rows):
        return spark.createDataFrame(rows, "source_id string, run_id int, seq int, started_at int, status string")
    write(batch(("s", 1, 3, 3, "done"), ("s", 1, 1, 1, "run"), ("s", 2, 2, 2, "run"), ("s", 1, 2, 2, "run")), 0)
    write(batch(("s", 1, 4, 4, "done"), ("s", 2, 5, 5, "failed"), ("t", 1, 6, 6, "run")), 1)
    write(batch(("s", 2, 7, 7, "run")), 2)
    write(batch(("s", 2, 7, 7, "run")), 2)
    got = {(r.source_id, r.run_id, r.seq, r.status, r.previous) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("s", 1, 1, "run", None), ("s", 1, 3, "done", "run"), ("s", 2, 2, "run", None), ("s", 2, 5, "failed", "run"),
                   ("t", 1, 6, "run", None), ("s", 2, 7, "run", "failed")}
