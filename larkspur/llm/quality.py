"""Quality rules: hard limits first, then an isolation forest on the statistics that the rules are made of.

Every tree splits its own small sample at random; a document that ends after few splits is unlike the corpus. The score
2^(-mean path / expected path) is near 1 for such documents. Trees split on one statistic or on all, in equal parts, and
each part has a score of its own, as being unusual in one statistic may be harmless and in another not. The score of a
part above which a document goes is calibrated from labelled rows: of the limits that lose at most `MAX_LOSS` of the
good ones, the one that best separates good from bad; the best part is calibrated first, the next on what it leaves.

Scale: one pass over the text gives a few numbers a row, written to the shared folder; everything else reads those. A
forest is fitted on `TREES` x `TREE_ROWS` rows, chosen by hash among all rows that pass the limits, a tree a task. The
calibration counts all labelled rows into `BINS` bins by label before anything reaches the driver.

Defined cases: a null or empty text has no words and fails; repeated rows are scored alike; a document labelled twice
counts as its worst label; labels with nulls are ignored; without labelled rows of both kinds only the limits decide, as
they do in a table without rows to fit on; rows with equal statistics have equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c

MIN_WORDS, MAX_REPEAT = 50, 50  # words; per cent of words in repeated windows
TREES, TREE_ROWS = 160, 256
MAX_LOSS, BINS = 0.005, 2000
_SYMBOLS = c.byte_set(b"#*$%&|<>")
_CHARS = ~c.SPACES & ((np.arange(256) & 0xC0) != 0x80)
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_PARTS = len(_STATS)  # a part for each rate, and one for all of them


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[off])


def statistics(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns of `_STATS` for the rows of a block."""
    starts, ends, rows = c.spans(buf, off, ~c.SPACES)
    counts, n = np.diff(rows), len(off) - 1
    # lines: a line ends at a newline or at its row's end
    inner = np.flatnonzero(buf == 10)
    first = np.sort(np.concatenate((off[:-1], inner + 1)), kind="stable")
    last = np.sort(np.concatenate((off[1:], inner)), kind="stable")
    owner = np.repeat(np.arange(n), _per_row(buf == 10, off) + 1)
    worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, owner = first[worded], last[worded], owner[worded]
    hashes = c.span_hashes(buf, first, last)
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    dup_lines = np.bincount(owner[order][1:][same], minlength=n)
    # windows of three words
    grams = c.gram_hashes(c.span_hashes(buf, starts, ends), 3)
    again = np.zeros(len(starts), bool)
    if len(grams):
        home = c.rows_of(counts)
        valid = np.flatnonzero(home[:len(grams)] == home[2:])
        key = c.mix(grams[valid] ^ c.mix(home[valid].astype(np.uint64) + c.U64(1)))
        order = np.argsort(key)
        pair = key[order][1:] == key[order][:-1]
        hit = valid[np.union1d(order[1:][pair], order[:-1][pair])]
        for j in range(3):
            again[hit + j] = True
    return [counts, _per_row(_CHARS[buf], off), _per_row(_SYMBOLS[buf], off), dup_lines, _per_row(again, rows)]


def _measure(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in c.blocks(batch.column(len(keep))):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(x, pa.int64()) for x in statistics(buf, off))], [*keep, *_STATS])

    return run


def rates(stats: pd.DataFrame) -> np.ndarray:
    """What the forest sees: letters a word, symbols, duplicate lines and repeated words by word."""
    n = np.maximum(stats["n_words"].to_numpy(float), 1)
    return np.stack([stats[x].to_numpy(float) / n for x in _STATS[1:]], 1)


def grow(x: np.ndarray, part: int, rng: np.random.Generator) -> dict[str, list]:
    """An isolation tree of a part as arrays; a leaf has feature -1 and in `value` its expected path length."""
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    tree: dict[str, list] = {"feature": [], "value": [], "left": [], "right": []}
    pending = [(x, 0, None, None)]
    while pending:
        rows, depth, parent, side = pending.pop()
        at = len(tree["feature"])
        if parent is not None:
            tree[side][parent] = at
        low, high = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(high > low)
        if part < len(low):
            open_ = open_[open_ == part]
        if depth >= limit or len(rows) <= 1 or not len(open_):
            node = (-1, depth + expected_path(len(rows)), -1, -1)
        else:
            f = int(rng.choice(open_))
            node = (f, float(rng.uniform(low[f], high[f])), -1, -1)
            below = rows[:, f] < node[1]
            pending += [(rows[below], depth + 1, at, "left"), (rows[~below], depth + 1, at, "right")]
        for k, v in zip(tree, node):
            tree[k].append(v)
    return tree


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["order", *_STATS], kind="stable")
    number = int(rows["tree"].iloc[0])
    tree = grow(rates(rows), number % _PARTS, np.random.default_rng(number))
    return pd.DataFrame({"tree": rows["tree"].iloc[:1], "rows": [len(rows)], **{k: [v] for k, v in tree.items()}})


def path_scores(forest: list, x: np.ndarray) -> np.ndarray:
    """Row x part matrix of scores."""
    total, usual = np.zeros((len(x), _PARTS)), np.zeros(_PARTS)
    for tree in forest:
        feature, value = np.array(tree["feature"]), np.array(tree["value"])
        child = np.stack([np.array(tree["right"]), np.array(tree["left"])])
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            node = at[live]
            at[live] = child[(x[live, feature[node]] < value[node]).astype(int), node]
            live = live[feature[at[live]] >= 0]
        part = tree["tree"] % _PARTS
        total[:, part] += value[at]
        usual[part] += expected_path(tree["rows"])
    return 2.0 ** (-total / np.maximum(usual, 1e-9))


def _score(forest, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = path_scores(forest.value, rates(batch.select(list(_STATS)).to_pandas()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, _PARTS), pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*keep, *_STATS, "scores"])

    return run


def calibrate(counts: pd.DataFrame, max_loss: float) -> tuple[float, float]:
    """(limit on the score, share of bad less share of good ones lost) from counts by (bin, quality); a bin goes whole."""
    table = np.zeros((2, BINS + 1))
    np.add.at(table, (counts["quality"].to_numpy(int), counts["bin"].to_numpy(int)), counts["n"].to_numpy(float))
    if not table.sum(1).all():
        return float("inf"), 0.0
    gone = table[:, ::-1].cumsum(1)[:, ::-1] / table.sum(1, keepdims=True)  # share of each kind at or above a bin
    gain = np.where(gone[1] <= max_loss, gone[0] - gone[1], -1)
    return float(gain.argmax()) / BINS, float(gain.max())


def _limits(labelled: DataFrame, max_loss: float) -> list[float]:
    """A limit for each part: the part that separates best first, the others on what it leaves."""
    limits = [float("inf")] * _PARTS
    for _ in range(_PARTS):
        left = labelled.where(~_over(limits)).select("quality", F.posexplode("scores").alias("part", "score"))
        counts = left.groupBy("part", F.floor(F.col("score") * BINS).cast("int").alias("bin"), "quality").agg(F.count("*").alias("n")).toPandas()
        open_ = [p for p in range(_PARTS) if limits[p] == float("inf")]
        found = {p: calibrate(counts[counts["part"] == p], max_loss) for p in open_}
        best = max(open_, key=lambda p: found[p][1])
        if found[best][1] <= 0:
            break
        limits[best] = found[best][0]
    return limits


def _over(limits: list[float]):
    over = F.lit(False)
    for part, limit in enumerate(limits):
        over = over | (F.col("scores")[part] >= limit)
    return over


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
          trees: int = TREES, tree_rows: int = TREE_ROWS, max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per document: id, the statistics, base_failed, scores (by part) and kept."""
    spark = docs.sparkSession
    c.ship_package(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{x} long" for x in _STATS)
    stats = c.materialize(source.mapInArrow(_measure(["id"]), f"id {kind}, {columns}"), "statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    order = F.xxhash64(F.lit(11), "id", *_STATS)
    sample = stats.where(~failed).select(*_STATS, order.alias("order")).orderBy("order", *_STATS).limit(trees * tree_rows)
    sample = sample.withColumn("tree", F.pmod(F.xxhash64(F.lit(13), "order"), F.lit(trees)).cast("int"))
    forest = sample.groupBy("tree").applyInPandas(_grow, "tree int, rows int, feature array<int>, value array<double>, left array<int>, right array<int>").collect()
    shared = spark.sparkContext.broadcast([r.asDict() for r in sorted(forest, key=lambda r: r["tree"])])
    scored = stats.mapInArrow(_score(shared, ["id"]), f"id {kind}, {columns}, scores array<double>")
    known = labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("quality")).where(F.col("id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    labelled = c.materialize(scored.where(~failed).join(known, "id").select("quality", "scores"), "labelled")
    unusual = _over(_limits(labelled, max_loss))
    return scored.select(F.col("id").alias(id_col), *_STATS, failed.alias("base_failed"), "scores", (~failed & ~unusual).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: `judge` over whole documents, calibrated with all labels."""
    got = judge(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))
    return got.select("doc_id", *_STATS, "base_failed", "kept")
