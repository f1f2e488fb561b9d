"""Language identification against plain versions: features, choice of the sample, and the two levels of the choice."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common as c
from larkspur.llm import language
from tests.llm import fixtures


def plain_features(text):
    data, out = bytearray(), np.zeros(language.WIDTH, np.float64)
    for ch in text:
        if ch.isascii():
            data += ch.lower().encode() if ch.isalpha() else b" "
        else:
            raw = bytearray(ch.encode())
            if raw[0] == 0xC3 and 0x80 <= raw[1] <= 0x9E and raw[1] != 0x97:
                raw[1] += 0x20
            data += raw
    folded = [b for i, b in enumerate(data) if not (b == 32 and i and data[i - 1] == 32)]
    for k in language.GRAMS:
        for i in range(len(folded) - k + 1):
            code = 0
            for b in folded[i:i + k]:
                code = (code * 257 + b + 1) & 0xFFFFFFFF
            out[((code * 2654435761) & 0xFFFFFFFF) >> (32 - (language.WIDTH.bit_length() - 1))] += 1
    out = np.sqrt(out)
    return out / (np.linalg.norm(out) or 1)


def test_features_equal_a_plain_count():
    texts = ["", "The Cat", "ÄÖ × ÉÈ straße", "a  b\n\nc 12!", "漢字 x", " lead", "z" * 50]
    buf, off = c.raw(pa.array(texts))
    got = language.features(buf, off)
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-5)


def test_prediction_equals_a_plain_vote(spark):
    model = language.learn(fixtures.frame(spark))
    assert {len(model.langs), len(model.families)} == {4, 2}
    texts = [r[1] for r in fixtures.documents()[:60]]
    x = np.stack([plain_features(t) for t in texts])
    lang, score = model.predict(x.astype(np.float32))

    def chance(row, level, a, b):
        i = model.keys.index((level, a, b))
        return 1 / (1 + np.exp(-(row @ model.weights[i, :-1] + model.weights[i, -1]) * model.slopes[i]))

    def vote(row, level, names):
        support = collections.Counter(dict.fromkeys(names, 0.0))
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                p = chance(row, level, a, b)
                support[a] += p
                support[b] += 1 - p
        best = max(names, key=lambda n: support[n])
        return best, support[best] / (len(names) - 1) if len(names) > 1 else 1.0

    for row, got, sure in zip(x, lang, score):
        family, p = vote(row, "family", sorted(model.families))
        best, q = vote(row, "language", model.families[family])
        assert got == best and abs(p * q - sure) < 1e-3


@pytest.mark.parametrize("sample", [3, 40, 5000])
def test_sample_is_the_first_rows_in_hashed_order(spark, sample):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, "en").when(F.col("id") < 9, "rare").otherwise("de").alias("lang"), F.xxhash64("id").alias("order"),
                                    F.col("id").alias("rk1"), F.col("id").alias("rk2"))
    by = collections.defaultdict(list)
    for r in rows.collect():
        by[r.lang].append(r.order)
    got = collections.defaultdict(list)
    for r in language.sample_of(rows, sample).collect():
        got[r.lang].append(r.order)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:sample] for k, v in by.items() if len(v) >= language.LEAST}
    assert "rare" in by and "rare" not in got


def test_many_short_rows_stay_in_small_blocks():
    texts = pa.array(["ab"] * 5000)
    assert max(hi - lo for lo, hi, _, _ in c.blocks(texts, rows=language.ROWS)) == language.ROWS


def test_every_labelled_row_is_dealt_into_a_part(spark):
    """No row is left out of the fit, and a language of few rows is in every part."""
    rows = spark.range(4000).select(F.when(F.col("id") < 30, "rare").when(F.col("id") < 900, "de").otherwise("en").alias("lang"), F.xxhash64("id").alias("order"), F.col("id").cast("string").alias("text"))
    got = language.dealt(rows, {"rare": 30, "de": 870, "en": 3100}).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.part].add(r.lang)
    assert {r.text for r in got} == {str(i) for i in range(4000)}
    assert len(by) == 6 and all(langs == {"rare", "de", "en"} for langs in by.values())
    assert collections.Counter(r.lang for r in got) == {"rare": 180, "de": 870, "en": 3100}


def test_model_of_several_parts_reads_all_rows(spark, monkeypatch):
    """With parts of ten rows the mean of their machines still tells the labelled texts apart."""
    monkeypatch.setattr(language, "PART", 10)
    docs = fixtures.frame(spark)
    model = language.learn(docs)
    rows = docs.where("lang is not null and text is not null").collect()
    lang, _ = model.predict(language.features(*c.raw(pa.array([r.text for r in rows]))))
    assert np.mean(lang == np.array([r.lang for r in rows], object)) > 0.9 and model.limit < 0.5


def test_row_coefficients_give_the_same_machine():
    """With fewer rows than columns the steps are taken on the rows; columns of zeros change the way, not the weights."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 20)).astype(np.float32)
    x = language.with_bias(x / np.linalg.norm(x, axis=1, keepdims=True))
    y = np.where(x[:, 0] + 0.1 * x[:, 1] > 0, 1, -1).astype(np.float32)
    wide = np.hstack([np.zeros((60, 100), np.float32), x])
    assert np.allclose(language.fit_margin(wide, y)[100:], language.fit_margin(x, y), atol=1e-3)
