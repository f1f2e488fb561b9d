"""Hints count wherever they stand in a text."""

import __spark_entry__ as entry_module


def test_hint_after_the_first_line(spark, tmp_path):
    docs = [(i, "word\nin the second line" if i == 5 else "word\nnothing", "en" if i < 2 else "fr", f"src{i % 3}", 20) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.item_id: r.reason for r in entry_module.queries()["cls_sample_target"](spark, str(tmp_path)).collect()}
    assert [k for k, v in got.items() if v == "near_miss"] == [5]
    assert sorted(k for k, v in got.items() if v == "primary") == [0, 1]
