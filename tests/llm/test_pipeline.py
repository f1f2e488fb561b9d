"""The stages of the pipeline, each against what it must keep."""

import collections
import re

import corpus_pipeline
from larkspur.llm import common
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_identification", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        counts.append(len(rows))
        assert all(r.n_chars == len(r.text) for r in rows)
        if name == "line_dedup":
            seen = collections.Counter(k for r in rows for k in {x.strip().lower() for x in r.text.split("\n")} if k)
            assert max(seen.values()) < 10
        if name == "decontamination":
            word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            fold = lambda t: word.findall(t.lower())
            grams = {tuple(w[i:i + 10]) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [fold(x.text)] for i in range(len(w) - 9)}
            assert not any(tuple(w[i:i + 10]) in grams for r in rows for w in [fold(r.text)] for i in range(len(w) - 9))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in rows}
    assert counts[0] >= counts[1] >= counts[2] > counts[3] > 50


def test_awkward_documents(spark):
    docs = fixtures.frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), name)
    left = docs.collect()
    assert not any(r.text is None or not any(ch.isalpha() for ch in r.text) for r in left)
    assert len({(r.doc_id, r.text) for r in left}) == len(left)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_empty(spark):
    docs = fixtures.frame(spark, [], clash=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF) if docs.columns[0] == "doc_id" else docs
    assert docs.count() == 0
