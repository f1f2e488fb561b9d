"""Removal of repeated passages by sliding spans of sentences.

A span is the shortest run of sentences, from each sentence forwards and from each sentence backwards, that has
`SENTENCES` sentences and `SPAN_WORDS` words, or `PASSAGE_WORDS` words in fewer sentences. Equal spans are joined over
the whole corpus; all but the first one (smallest id, then place) cover their sentences, and covered sentences go.

Scale: the first pass over the texts counts spans by one hash, combined before the shuffle; the second keeps spans whose
hash occurs again (a bit set of fixed size filters them, the grouping that follows is exact under 128 bits). First
places come from an aggregate, so a passage in a third of all documents is one row a task; going back to the documents is
an inner join whose large side can be split. The text is shuffled once, to its removed spans.

Defined cases: a null or empty text has no sentence; words are compared without regard to A-Z case and white space;
repeated rows are copies, and as they cannot be told apart each keeps what the first of them keeps; null ids come last;
what stands before the first sentence stays; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c

SENTENCES, SPAN_WORDS, PASSAGE_WORDS = 3, 25, 40
REPEAT_BITS = 25
_STOPS = c.byte_set(b".!?")
_CLOSERS = c.byte_set(b"\"')]}")


def sentences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, first word of each sentence (and the number of words), first sentence of each row (and the number)."""
    starts, ends, rows = c.spans(buf, off, ~c.SPACES)
    n = len(starts)
    if not n:
        return starts, ends, np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    last = ends - 1
    for _ in range(3):  # a stop may stand before closing marks
        back = _CLOSERS[buf[last]] & (last > starts)
        last = last - back
    stop = _STOPS[buf[last]]
    newlines = np.concatenate(([0], np.cumsum(buf == 10)))
    stop[:-1] |= newlines[starts[1:]] > newlines[ends[:-1]]
    first = np.zeros(n, bool)
    first[1:] = stop[:-1]
    first[rows[:-1][rows[:-1] < rows[1:]]] = True
    begin = np.flatnonzero(first)
    return starts, ends, np.append(begin, n), np.searchsorted(begin, rows)


def sentence_spans(buf: np.ndarray, off: np.ndarray, count: int, words: int, passage: int) -> tuple[np.ndarray, ...]:
    """(row, first sentence, last sentence) within rows, and two hashes, of every span."""
    starts, ends, begin, rows = sentences(buf, off)
    n = len(begin) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.arange(n)
    home = np.searchsorted(rows, at, "right") - 1
    reach = lambda k: np.searchsorted(begin, begin[:-1] + k) - 1  # noqa: E731  last sentence of k words from each start
    last = np.minimum(np.maximum(at + count - 1, reach(words)), reach(passage))
    ok = last < rows[home + 1]
    back = lambda k: np.searchsorted(begin, begin[1:] - k, "right") - 1
    first = np.maximum(np.minimum(at - count + 1, back(words)), back(passage))
    ok2 = first >= rows[home]
    pairs = np.unique(np.concatenate((at[ok] * (n + 1) + last[ok], first[ok2] * (n + 1) + at[ok2])))
    a, b = pairs // (n + 1), pairs % (n + 1)
    word = c.span_hashes(c.lower_ascii(buf), starts, ends)
    up, down = c._powers(1 << max(20, (len(word) + 1).bit_length()))
    found = []
    for salt in (0, 0x5DEECE66D):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.mix(word ^ c.U64(salt)) * up[:len(word)], dtype=np.uint64)))
        found.append(c.mix((sums[begin[b + 1]] - sums[begin[a]]) * down[begin[a]] ^ (begin[b + 1] - begin[a]).astype(np.uint64)))
    return home[a], a - rows[home[a]], b - rows[home[a]], found[0], found[1]


def _count(count: int, words: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in c.blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(c.signed(sentence_spans(buf, off, count, words, passage)[3]))], ["h1"])

    return run


def _again(count: int, words: int, passage: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in c.blocks(batch.column(3)):
                row, first, last, h1, h2 = sentence_spans(buf, off, count, words, passage)
                some = c.in_bit_set(bits.value, h1)
                part, take = batch.slice(lo, hi - lo), pa.array(row[some])
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), pa.array(first[some]), pa.array(last[some]), pa.array(c.signed(h1[some])), pa.array(c.signed(h2[some]))],
                                                 ["rk1", "rk2", "id", "first", "last", "h1", "h2"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in c.blocks(batch.column(1)):
            starts, _, begin, rows = sentences(buf, off)
            part = batch.slice(lo, hi - lo)
            kept, removed = [], []
            for r, pairs in enumerate(part.column(2).to_pylist()):
                if not pairs:
                    kept.append(buf[off[r]:off[r + 1]].tobytes())
                    removed.append(0)
                    continue
                gone = np.zeros(rows[r + 1] - rows[r] + 1, np.int32)
                np.add.at(gone, [p["first"] for p in pairs], 1)
                np.add.at(gone, [p["last"] + 1 for p in pairs], -1)
                gone = np.cumsum(gone[:-1]) > 0
                edges = np.append(starts[begin[rows[r]:rows[r + 1]]], off[r + 1])
                parts = [buf[off[r]:edges[0]]] + [buf[edges[i]:edges[i + 1]] for i in np.flatnonzero(~gone)]
                kept.append(b"".join(x.tobytes() for x in parts))
                removed.append(int(gone.sum()))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(rows)), pa.array(removed, pa.int64()), text], ["id", "n_sentences", "n_removed", "text"])


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = SENTENCES, words: int = SPAN_WORDS,
                    passage: int = PASSAGE_WORDS) -> DataFrame:
    """One row per document: id, n_sentences, n_removed and the text that stays."""
    spark = docs.sparkSession
    c.ship_package(spark)
    source = docs.select(*c.row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    hashes = source.select("text").mapInArrow(_count(count, words, passage), "h1 long")
    twice = c.materialize(hashes.groupBy("h1").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h1"), "repeated")
    bits = spark.sparkContext.broadcast(c.bit_set(twice, "h1", REPEAT_BITS))
    spans = c.materialize(source.mapInArrow(_again(count, words, passage, bits), f"rk1 long, rk2 long, id {kind}, first long, last long, h1 long, h2 long"), "sentence-spans")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "rk1", "rk2", "first")
    firsts = spans.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("origin")).where(F.col("n") > 1)
    firsts = c.materialize(firsts.select("h1", "h2", "origin"), "first-spans")  # a plain table: the spans of the join can be split
    covered = spans.join(firsts, ["h1", "h2"]).where(place != F.col("origin"))
    gone = covered.groupBy("rk1", "rk2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    got = source.join(gone, ["rk1", "rk2"], "left").select("id", "text", "spans").mapInArrow(_cut, f"id {kind}, n_sentences long, n_removed long, text string")
    return got.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: `remove_passages` over whole documents."""
    return remove_passages(c.table(spark, sf_dir, "documents"))
