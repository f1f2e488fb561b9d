"""Stages of the pipeline beside plain Python on what the stage before them kept."""

import collections
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, language
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def families(texts, size=5, percent=80):
    """Number of the group of every text; None without words."""
    sets = []
    for t in texts:
        w = SPACED.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in holders[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                group[find(i)] = find(j)
    return [find(i) if s else None for i, s in enumerate(sets)]


def contaminated(text, items):
    w = ITEM.findall((text or "").translate(FOLD))
    return any(tuple(w[i:i + len(g)]) == g for g in items for i in range(len(w) - len(g) + 1))


def windows(items):
    out = set()
    for t in items:
        w = ITEM.findall((t or "").translate(FOLD))
        n = min(10, len(w))
        out |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    return out


ODD = ["line_dedup", "line_dedup_", "a.b", "language.x"]


@pytest.mark.parametrize("table", ["given", "awkward"])
def test_stages(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table == "given" else fixtures.frame(spark)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ODD])
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    after = {}
    for name in list(stages)[:-1]:
        docs = common.materialize(stages[name](spark, docs, SF), name)
        assert docs.columns == columns
        after[name] = docs.collect()
    lines, near, clean = (after[x] for x in ("line_dedup", "near_dedup", "decontamination"))
    group = families([r.text for r in lines])
    stay, seen = collections.Counter(), {}
    for r, g in zip(lines, group):
        if g is None:
            seen["none", r.doc_id, r.text] = (r.doc_id, r.text)
        else:
            place = (r.doc_id is None, r.doc_id or 0)
            if g not in seen or place < seen[g][0]:
                seen[g] = (place, (r.doc_id, r.text))
    stay = collections.Counter(v[1] if isinstance(k, int) else v for k, v in seen.items())
    assert collections.Counter((r.doc_id, r.text) for r in near) == stay
    grams = windows([r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert collections.Counter((r.doc_id, r.text) for r in clean) == collections.Counter((r.doc_id, r.text) for r in near if not contaminated(r.text, grams))


def test_language_stage_keeps_what_the_model_accepts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    assert 0 < model.limit < 0.5
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    judged = {r["carry"].doc_id: r for r in language.identify(docs).collect()}
    assert kept == {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= model.limit}
    labelled = {r.doc_id for r in docs.where("lang is not null").collect()}
    assert len(labelled & kept) >= 0.995 * len(labelled)
    strange = spark.createDataFrame([(10 ** 6 + i, t, None, "s", len(t)) for i, t in enumerate(["漢字 仮名 " * 40, "qxzjk vwqxz " * 40, "12 34"])], docs.schema)
    left = corpus_pipeline.identify_language(spark, docs.union(strange), SF).where("doc_id >= 1000000").count()
    assert left < 3
