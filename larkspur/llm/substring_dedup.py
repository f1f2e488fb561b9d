"""Removal of repeated byte strings by bounded expansion of intervals on a Burrows-Wheeler transform.

A string of `length` bytes that starts at two places is removed at both. To bring equal strings together without a
global suffix array, every start position is assigned the minimum hash of the k-grams in its string; consecutive starts
whose minimum lies at the same place form a segment. Equal strings have equal minima, so all their starts lie in segments of one
group. A group of one segment has no repeat; segments with equal bytes repeat as a whole; the different segments of a
group are compared in blocks: suffixes are sorted, and a breadth-first backward extension of intervals on the transform
assigns common prefix lengths in increasing order and stops at `length`. Ranks left without a length share at least
`length` bytes with their neighbour, which is exactly the repeats.

Scale: the first pass over the text counts segments by minimum (about two for every `length` bytes), combined before the
shuffle; the second keeps those whose minimum occurs again (bit sets of fixed size filter them, the grouping that
follows is exact) and carries bytes only where a minimum has different segments. The text itself is shuffled once, to
its removed spans. Copies are counted, not compared. Blocks hold whole groups; a group of more than `BLOCK` bytes of different segments is not brought to one task but
resolved by counting a digest of every string in it, which any number of tasks can share.

Defined cases: a null text is empty; a text shorter than `length` loses nothing itself and repeats nothing; matches
never cross rows; repeated rows remove each other; strings are judged on the input; a text of one repeated byte is
removed whole; other columns are ignored. Removal is by byte, so what is left may split a character: it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c

LENGTH, GRAM = 200, 48  # a shorter gram is more often common by chance, a longer one gives more segments
BLOCK = 1 << 20
SHARED_BITS = 25


# --- segments -----------------------------------------------------------------------------------------------------


def _gram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each place: pieces of 1, 2, 4 ... bytes, joined as the bits of k ask."""
    n = len(buf) - k + 1
    piece, size, done, total = c.mix(buf.astype(np.uint64) + c.U64(1)), 1, 0, np.zeros(n, np.uint64)
    while True:
        if k & size:
            total = total * c.U64(0x9E3779B97F4A7C15) + piece[done:done + n]
            done += size
        if 2 * size > k:
            return c.mix(total)
        piece = piece[:-size] * c.U64(0xD6E8FEB86659FD93) + (piece[size:] ^ (piece[size:] >> c.U64(29)))
        size *= 2


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == w else np.minimum(x[:len(x) - (w - have)], x[w - have:])


def segment_runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start, minimum) of every run of starts with one leftmost minimum; places in the buffer."""
    if len(buf) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    grams = _gram_hash(buf, gram)
    low = _sliding_min(grams, length - gram + 1)
    edge = np.zeros(len(buf) + 1, np.int32)
    long = np.diff(off) >= length
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, off[1:][long] - length + 1, -1)
    inside = np.cumsum(edge)[:len(low)] > 0
    new = np.ones(len(low), bool)
    # the minimum changes, or it was the first gram of the string before
    new[1:] = (low[1:] != low[:-1]) | (low[:-1] == grams[:len(low) - 1]) | (inside[1:] != inside[:-1])
    new[off[:-1][long]] = True
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(low)) - 1
    keep = inside[start]
    start, last = start[keep], last[keep]
    return np.searchsorted(off, start, "right") - 1, start, last, low[start]


def _count_segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in c.blocks(batch.column(0)):
                _, start, last, low = segment_runs(buf, off, length, gram)
                view = memoryview(np.ascontiguousarray(buf))
                digests = [xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), (last + length).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(np.array(digests, np.uint64).view(np.int64))], ["low", "short"])

    return run


def _shared_segments(length: int, gram: int, again, several):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for first, _, buf, off in c.blocks(batch.column(2)):
                row, start, last, low = segment_runs(buf, off, length, gram)
                some = c.in_bit_set(again.value, low)
                row, start, last, low = row[some], start[some], last[some], low[some]
                view = memoryview(np.ascontiguousarray(buf))
                parts = [view[s:e] for s, e in zip(start.tolist(), (last + length).tolist())]
                full = c.in_bit_set(several.value, low).tolist()
                own = off[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rk[0][first + row]), pa.array(rk[1][first + row]), pa.array(start - own), pa.array(last - own), pa.array(low.view(np.int64)),
                     pa.array([xxhash.xxh3_128_digest(x) for x in parts], pa.binary()), pa.array([bytes(x) if f else None for x, f in zip(parts, full)], pa.binary())],
                    ["rk1", "rk2", "lo", "hi", "low", "digest", "bytes"])

    return run


# --- repeats within a block ---------------------------------------------------------------------------------------


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions sorted by their first `depth` codes at least, by prefix doubling; codes take 9 bits, the last is 0."""
    n, have = len(codes), 7
    padded = np.concatenate((codes, np.zeros(have, codes.dtype))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(have):
        key = (key << 9) | padded[j:j + n]
    order = np.argsort(key)
    placed = key[order]
    new = np.concatenate(([True], placed[1:] != placed[:-1]))
    heads = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = heads[np.cumsum(new) - 1]
    while have < depth:
        sizes = np.diff(np.append(heads, n))
        at = np.flatnonzero(np.repeat(sizes > 1, sizes))  # only shared ranks are sorted again, each within its own run
        if not len(at):
            break
        pos = order[at]
        key = rank[pos] * (n + 1) + np.where(pos + have < n, rank[np.minimum(pos + have, n - 1)] + 1, 0)
        again = np.argsort(key)
        order[at], key = pos[again], key[again]
        new[at] = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.flatnonzero(new)
        rank[order[at]] = heads[np.searchsorted(heads, at, "right") - 1]
        have *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Codes that each suffix in order shares with the one before it; `depth` stands for that many or more.

    An interval of ranks holds the suffixes that begin with one string. Extending it to the left by a code of the
    transform gives the interval of a string one longer. Intervals come by increasing length; the first that ends
    before a rank gives that rank its common prefix, and only such intervals are extended again.
    """
    n = len(codes)
    transform = codes[order - 1]
    to = np.empty(n, np.int64)  # rank of the suffix that is one code longer to the left
    to[np.argsort(transform, kind="stable")] = np.arange(n)
    out = np.full(n + 1, -1, np.int64)
    out[0] = 0
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for level in range(depth):
        if not len(lo):
            break
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        ranks = np.arange(len(owner)) + np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        target, code = to[ranks], transform[ranks]
        by = np.argsort(target)
        target, code, owner = target[by], code[by], owner[by]
        cut = np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))
        start = np.flatnonzero(cut)
        lo, hi = target[start], target[np.append(start[1:], len(target)) - 1] + 1
        fresh = out[hi] < 0
        out[hi] = np.where(fresh, level, out[hi])
        fresh &= hi < n
        lo, hi = lo[fresh], hi[fresh]
    return np.where(out[:n] < 0, depth, out[:n])


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of several byte strings, the starts of its substrings of `length` bytes that start anywhere else too."""
    sizes = np.array([len(p) for p in parts])
    off = np.concatenate(([0], np.cumsum(sizes + 1)))
    codes = np.ones(off[-1] + 1, np.int64)
    codes[-1] = 0
    for p, o in zip(parts, off.tolist()):
        codes[o:o + len(p)] = np.frombuffer(p, np.uint8)
        codes[o:o + len(p)] += 2
    order = suffix_order(codes, length)
    shared = common_prefixes(codes, order, length) >= length
    again = np.zeros(len(codes), bool)
    again[order[shared]] = True
    again[order[np.flatnonzero(shared) - 1]] = True
    return [np.flatnonzero(again[o:o + max(0, n - length + 1)]) for o, n in zip(off.tolist(), sizes.tolist())]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate(([0], cut))], starts[np.append(cut, len(starts)) - 1]


def _expand_blocks(length: int, block: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for (rk1, rk2, lo, n, _, _), starts in zip(rows, repeated_starts([r[5] for r in rows], length)):
            if n == 1 and len(starts):
                out += [(rk1, rk2, lo + a, lo + b + length) for a, b in zip(*(x.tolist() for x in _runs(starts)))]
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cols], ["rk1", "rk2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if size >= block and row[4] != held[-1][4]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return run


def _each_string(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rk1, rk2, lo, n, _, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                size = len(data) - length + 1
                view = memoryview(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rk1] * size, pa.int64()), pa.array([rk2] * size, pa.int64()), pa.array(np.arange(lo, lo + size)), pa.array([n] * size, pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(view[i:i + length]) for i in range(size)], pa.binary())], ["rk1", "rk2", "lo", "n", "string"])

    return run


# --- removal ------------------------------------------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in c.blocks(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            kept, removed, spans = [], [], []
            for r, pairs in enumerate(part.column(2).to_pylist()):
                own = buf[off[r]:off[r + 1]]
                if not pairs:
                    kept.append(own.tobytes())
                    removed.append(0)
                    spans.append(0)
                    continue
                edge = np.zeros(len(own) + 1, np.int32)
                np.add.at(edge, [p["lo"] for p in pairs], 1)
                np.add.at(edge, [p["hi"] for p in pairs], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(own[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """docs: (rk1, rk2, text). (rk1, rk2, lo, hi): bytes lo to hi - 1 of a text lie in strings that start elsewhere too."""
    spark = docs.sparkSession
    if not 1 <= gram <= length:
        raise ValueError("gram must lie between 1 and length")
    counted = docs.select("text").mapInArrow(_count_segments(length, gram), "low long, short long")
    lows = c.materialize(counted.groupBy("low").agg(F.count("*").alias("n"), F.min("short").alias("a"), F.max("short").alias("b")).where(F.col("n") > 1)
                         .select("low", (F.col("a") != F.col("b")).alias("several")), "lows")
    again = spark.sparkContext.broadcast(c.bit_set(lows, "low", SHARED_BITS))
    several = spark.sparkContext.broadcast(c.bit_set(lows.where("several"), "low", SHARED_BITS))
    kind = "rk1 long, rk2 long, lo long, hi long, low long, digest binary, bytes binary"
    segments = c.materialize(docs.mapInArrow(_shared_segments(length, gram, again, several), kind), "segments")
    different = c.materialize(segments.groupBy("low", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("rk1", "rk2", "lo")).alias("at"), F.first("bytes").alias("bytes")), "different")
    copies = segments.join(different.where(F.col("n") > 1).select("low", "digest"), ["low", "digest"])
    whole = copies.select("rk1", "rk2", "lo", (F.col("hi") + length).alias("hi"))
    groups = different.where(F.col("bytes").isNotNull()).groupBy("low").agg(F.count("*").alias("members"), F.sum(F.length("bytes")).alias("size")).where(F.col("members") > 1)
    rows = different.join(groups, "low").select("at.rk1", "at.rk2", "at.lo", "n", "low", "bytes", "size")
    small = rows.where(F.col("size") <= block).drop("size").repartition("low").sortWithinPartitions("low")
    within = small.mapInArrow(_expand_blocks(length, block), "rk1 long, rk2 long, lo long, hi long")
    each = rows.where(F.col("size") > block).drop("size").mapInArrow(_each_string(length), "rk1 long, rk2 long, lo long, n long, string binary")
    twice = each.groupBy("string").agg(F.count("*").alias("times")).where(F.col("times") > 1).select("string")
    large = each.where(F.col("n") == 1).join(twice, "string").select("rk1", "rk2", "lo", (F.col("lo") + length).alias("hi"))
    return whole.union(within).union(large)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay)."""
    c.ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), *c.row_key(id_col, text_col), F.col(text_col).alias("text"))
    found = c.materialize(repeated_spans(source.select("rk1", "rk2", "text"), length, gram, block), "spans")
    spans = found.groupBy("rk1", "rk2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    got = source.join(spans, ["rk1", "rk2"], "left").select("id", "text", "spans").mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return got.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the digest of `remove_repeats` over whole documents."""
    got = remove_repeats(c.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
