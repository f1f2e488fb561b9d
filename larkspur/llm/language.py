"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

Texts become hashed byte n-grams (one to three bytes, case folded, runs of other characters as one space), square-rooted
and normalised. Families are told apart by the same kind of machine. The labelled documents, all of them, are dealt into
parts; a part fits each two-sided problem and calibrates its margin on a fifth of its rows that the fit does not see, and
the model is the mean of the calibrated machines of all parts.

Scale: a part holds about `PART` documents of the largest language, or fewer with many languages, so a task's arrays are
bounded and their number grows with the rows. A language of less than `LEAST_PART` rows a part is in several parts with the same rows, so that every
part knows it. Machines are summed as integers, in the tasks first, so a problem's sum does not depend on their order.
The score limit comes from counts of all labelled rows by score, in one pass without a shuffle of texts. The weights
(problems x 16 kB, problems bounded by the pairs of languages of a family and of families) are broadcast, and prediction
is one pass over whole texts without a shuffle, `ROWS` rows and about `BYTES` bytes at a time at most, so that a task
holds few copies of either.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text when no row teaches a
language; an empty or null language does not teach, nor does one with fewer than `LEAST` labelled rows; a row with a null id is not held out and does not teach; a language
missing from `FAMILIES` is a family of its own; ties go to the name that sorts first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import common as c

PART, LEAST_PART, STEPS = 600, 100, 100  # rows of the largest language in a part, of any other at least, steps of a fit
WIDTH, GRAMS = 4096, (1, 2, 3)
FIXED, BINS = 2.0 ** 32, 10_000  # unit of summed weights, and bins of the scores that the limit is read from
LEAST, ROWS, BYTES = 5, 128, 1 << 18  # rows and text bytes held as arrays at once
LOST = 0.001  # share of the labelled rows below the score at whose half a text is taken to be in none of the languages
HELD_OUT_OF, HELD_OUT = 3, 1
UNKNOWN = "und"
# Families of languages
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "celtic": ("br", "cy", "ga"),
    "malay": ("id", "jv", "ms", "su"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"lang:{lang}")


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row x WIDTH matrix of normalised n-gram weights."""
    n = len(off) - 1
    out = np.zeros((n, WIDTH), np.float32)
    text = _FOLD[buf]
    if len(buf) > 1:
        # capitals of Latin letters with marks: the second byte of C3 80 to C3 9E
        upper = (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3) & (text[1:] != 0x97)
        text[1:][upper] += 0x20
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    keep[off[:-1][off[:-1] < off[1:]]] = True
    row = np.repeat(np.arange(n), np.diff(off))[keep]
    text = text[keep].astype(np.uint32)
    for k in GRAMS:
        if len(text) < k:
            continue
        code = np.zeros(len(text) - k + 1, np.uint32)
        for j in range(k):
            code = code * np.uint32(257) + text[j:len(text) - k + 1 + j] + np.uint32(1)
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - (WIDTH.bit_length() - 1))
        one = row[:len(code)] == row[k - 1:]
        flat = row[:len(code)][one] * WIDTH + code[one]
        out += np.bincount(flat, minlength=n * WIDTH).reshape(n, WIDTH)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def fit_margin(x: np.ndarray, y: np.ndarray, strength: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights of an L2-regularised squared-hinge machine, by accelerated gradient steps; x bears the bias as last column.

    With fewer rows than columns the same steps are taken on a coefficient for each row, by the rows' inner products."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    few = len(x) < x.shape[1]
    inner = x @ x.T if few else None
    w = np.zeros(len(x) if few else x.shape[1], np.float32)
    v, t = w.copy(), 1.0
    rate = 1.0 / (2 * 2.0 + strength)  # rows have norm sqrt 2 with the bias
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (inner @ v if few else x @ v))
        pull = weight * y * slack
        grad = strength * v - 2 * (pull if few else x.T @ pull)
        nxt = v - rate * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = nxt + np.float32((t - 1) / t2) * (nxt - w), nxt, t2
    return x.T @ w if few else w


def calibrate(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve that fits the margins best."""
    slopes = np.geomspace(0.5, 40, 60)
    losses = [np.logaddexp(0, -s * margin * y).mean() + 1e-4 * s for s in slopes]
    return float(slopes[int(np.argmin(losses))])


def _fit_part(problems: list):
    """All problems of one part, of which both sides are there: weights times slope. Every fifth row is held back from the fit."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates().sort_values(["order", "text", "lang"], kind="stable")
        x = with_bias(np.concatenate([features(buf, off) for _, _, buf, off in c.blocks(pa.array(rows["text"], pa.large_string()), BYTES, ROWS)]))
        lang, out = rows["lang"].to_numpy(), []
        for level, a, b, left, right in problems:
            y = np.where(np.isin(lang, left), 1, np.where(np.isin(lang, right), -1, 0)).astype(np.float32)
            at = np.flatnonzero(y)
            held = np.arange(len(at)) % 5 == 0
            fit, check = at[~held], at[held]
            if len(np.unique(y[fit])) < 2:
                continue
            w = fit_margin(x[fit], y[fit], steps=STEPS)
            out.append((level, a, b, 1, (w * np.float64(calibrate(x[check] @ w, y[check])) * FIXED).astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["level", "a", "b", "parts", "weights"])

    return run


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Machines of a task, summed by problem."""
    total: dict[tuple, list] = {}
    for frame in frames:
        for level, a, b, parts, weights in frame.itertuples(index=False):
            held = total.setdefault((level, a, b), [0, np.zeros(WIDTH + 1, np.int64)])
            held[0] += parts
            held[1] += np.frombuffer(weights, "<i8")
    yield pd.DataFrame([(*key, parts, w.astype("<i8").tobytes()) for key, (parts, w) in total.items()], columns=["level", "a", "b", "parts", "weights"])


def _problems(langs: list[str]) -> list[tuple[str, str, str, tuple[str, ...], tuple[str, ...]]]:
    """(level, a, b, languages of a, languages of b), names in order."""
    by: dict[str, list[str]] = {}
    for lang in sorted(langs):
        by.setdefault(family(lang), []).append(lang)
    names = sorted(by)
    out = [("family", a, b, tuple(by[a]), tuple(by[b])) for i, a in enumerate(names) for b in names[i + 1:]]
    return out + [("language", a, b, (a,), (b,)) for f in names for i, a in enumerate(by[f]) for b in by[f][i + 1:]]


class Model:
    """Fitted problems, as arrays for prediction."""

    limit = 0.0

    def __init__(self, langs: list[str], fitted: list):
        self.langs = sorted(langs)
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(family(lang), []).append(lang)
        self.keys = [(r["level"], r["a"], r["b"]) for r in fitted]
        rows = [np.frombuffer(r["weights"], "<i8") / FIXED / r["parts"] for r in fitted]
        self.weights = np.stack(rows).astype(np.float32) if rows else np.zeros((0, WIDTH + 1), np.float32)
        self.slopes = np.ones(len(rows))  # the weights hold them

    def _choose(self, level: str, names: list[str], chance: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with the most one-versus-one support, and its mean support."""
        if len(names) == 1:
            return np.zeros(n, int), np.ones(n)
        support = np.zeros((len(names), n))
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                p = chance[level, a, names[j]]
                support[i] += p
                support[j] += 1 - p
        best = support.argmax(0)
        return best, support[best, np.arange(n)] / (len(names) - 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        margin = (x @ self.weights[:, :-1].T + self.weights[:, -1]) * self.slopes
        p = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        chance = {k: p[:, i] for i, k in enumerate(self.keys)}
        names = sorted(self.families)
        best, sure = self._choose("family", names, chance, n)
        lang, score = np.empty(n, object), np.zeros(n)
        for f, name in enumerate(names):
            at = np.flatnonzero(best == f)
            own, inner = self._choose("language", self.families[name], {k: v[at] for k, v in chance.items()}, len(at))
            lang[at] = np.array(self.families[name], object)[own]
            score[at] = sure[at] * inner
        return lang, score


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(HELD_OUT_OF)) == HELD_OUT, F.lit(False))


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in c.blocks(batch.column(0), BYTES, ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(model.value.predict(features(buf, off))[1])], ["score"])

    return run


def dealt(labelled: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Rows with their part. A language too small for all parts has fewer places, each of which is several parts."""
    parts = max(1, -(-max(counts.values()) // PART), -(-sum(counts.values()) // (4 * PART)))
    places = {lang: min(parts, max(1, n // LEAST_PART)) for lang, n in counts.items()}
    table = labelled.sparkSession.createDataFrame(sorted(places.items()), "lang string, places int")
    first = F.pmod(F.xxhash64(F.lit(11), "order", "text"), F.col("places")).cast("int")
    return labelled.join(F.broadcast(table), "lang").select("lang", "order", "text", F.explode(F.sequence(first, F.lit(parts - 1), F.col("places"))).alias("part"))


def sample_of(labelled: DataFrame, sample: int) -> DataFrame:
    """labelled: (lang, order, rk1, rk2). At most `sample` rows of each language, by their place in a hashed order."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    counts = c.materialize(counts, "languages")
    share = F.lit(sample + 8 * sample ** 0.5 + 20) / F.col("n")  # a few more than asked for lie below the bound
    bound = F.when(share < 1, (share * 2.0 ** 64 - 2.0 ** 63).cast("long"))
    near = labelled.join(counts.select("lang", bound.alias("bound")), "lang").where(F.col("bound").isNull() | (F.col("order") < F.col("bound")))
    order = Window.partitionBy("lang").orderBy("order", "rk1", "rk2")
    return near.select("lang", "order", "rk1", "rk2").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).drop("rank")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int | None = None) -> Model:
    """Model from all labelled rows that are not held out, or from a sample of a given size of each language."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & (F.col(lang_col) != "") & F.col(text_col).rlike(r"\p{L}"))
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(7), F.col(id_col)).alias("order"), F.col(text_col).alias("text"), *c.row_key(id_col, text_col))
    if sample:
        keys = c.materialize(labelled.drop("text"), "labelled")
        labelled = labelled.join(c.materialize(sample_of(keys, sample).distinct(), "sample"), ["lang", "order", "rk1", "rk2"], "left_semi")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect() if r[1] >= LEAST}
    problems = _problems(list(counts))
    if not problems:
        return Model(list(counts), [])
    schema = "level string, a string, b string, parts long, weights binary"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, as small parts would be merged into few tasks
    fitted = dealt(labelled, counts).repartition(width, "part").groupBy("part").applyInPandas(_fit_part(problems), schema).mapInPandas(_summed, schema)
    fitted = fitted.groupBy("level", "a", "b").applyInPandas(lambda rows: next(_summed(iter([rows]))), schema).collect()
    found = {(r["level"], r["a"], r["b"]): r for r in fitted}
    none = np.zeros(WIDTH + 1, "<i8").tobytes()
    model = Model(list(counts), [found.get(p[:3]) or {"level": p[0], "a": p[1], "b": p[2], "parts": 1, "weights": none} for p in sorted(problems)])
    known = labelled.where(F.col("lang").isin(list(counts))).select("text")
    scores = known.mapInArrow(c.lean(_scores(spark.sparkContext.broadcast(model))), "score double")
    bins = scores.groupBy(F.floor(F.col("score") * BINS).alias("bin")).count().orderBy("bin").collect()  # at most BINS + 1 rows
    below, bound = 0, LOST * sum(r[1] for r in bins)
    for edge, n in bins:
        model.limit = edge / BINS / 2
        below += n
        if below > bound:
            break
    return model


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in c.blocks(batch.column(2), BYTES, ROWS):
                lang, score = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                at = np.flatnonzero(letters[lo:hi])
                if len(at) and known.langs:
                    lang[at], score[at] = (v[at] for v in known.predict(features(buf, off)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score),
                                                  pa.array((lang != UNKNOWN) & (score >= known.limit))], ["carry", "held_out", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per document: a struct `carry` of the named columns (the id by default), held_out, lang_pred, score, and
    accepted (a language was told, at half the score that all but `LOST` of the labelled rows reach, or more)."""
    spark = docs.sparkSession
    c.ship_package(spark)
    model = spark.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, sample))
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.struct(*[F.col(f"`{x}`") for x in carry or [id_col]]).alias("carry"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), letters.alias("letters"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return source.mapInArrow(c.lean(_predict(model)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: `identify` over whole documents."""
    return identify(c.table(spark, sf_dir, "documents")).select("carry.doc_id", "held_out", "lang_pred", "score")
