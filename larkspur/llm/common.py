"""Pieces shared by the operators: keys of rows and texts, blocks of Arrow text, word hashes in numpy."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import materialize, ship_package  # noqa: F401  (re-exported to the operators)

U64 = np.uint64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the package is sent to the workers first, as most operators run a function of it there."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column | str, name: str = "tk") -> list[Column]:
    """Two 64-bit hashes of a text (null is empty) under different seeds: rows equal in both have the same text."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(t).alias(f"{name}1"), F.xxhash64(F.lit(1), t).alias(f"{name}2")]


def row_key(*cols: str, name: str = "rk") -> list[Column]:
    """Two 64-bit hashes of several columns; nulls are told from other values. Rows equal in both are repeats."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias(f"{name}1"), F.xxhash64(F.lit(1), *parts).alias(f"{name}2")]


# --- Arrow text in numpy ------------------------------------------------------------------------------------------


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null row is empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def blocks(texts: pa.Array, size: int = _BLOCK, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most `rows` rows and about `size` bytes (a longer row is a run of its own): first row, end row, bytes, offsets."""
    buf, off = raw(texts)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        if rows:
            end = min(end, row + rows)
        yield row, end, buf[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


def byte_set(spec: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(spec)] = True
    return lut


SPACES = byte_set(b" \t\n\x0b\x0c\r")
ITEM_WORD = byte_set(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER_LUT = np.arange(256, dtype=np.uint8)
_LOWER_LUT[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER_LUT[buf]


def spans(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that stay within a row: starts, ends, and the first run of each row (rows + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = member[buf]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = off[:-1] < off[1:]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, U64), np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the sorted, disjoint spans, from prefix sums of blocks."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    while i < n:
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        size = int(ends[j - 1] - lo)
        up, down = _powers(1 << max(20, (size + 1).bit_length()))
        sums = np.zeros(size + 1, U64)
        part = buf[lo:lo + size].astype(U64)
        part += U64(1)
        part *= up[:size]
        np.cumsum(part, out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * down[s]
        i = j
    return mix(out ^ (ends - starts).astype(U64))


_PLACES = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], U64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, in order; entries that cross rows are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n] * _PLACES[0]
    for j in range(1, k):
        out += words[j:j + n] * _PLACES[j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows_of(counts: np.ndarray) -> np.ndarray:
    """Row index of every item when row i has counts[i] items."""
    return np.repeat(np.arange(len(counts)), counts)


# --- memory of a worker -------------------------------------------------------------------------------------------


def _release() -> None:
    """Drops what functions of other stages keep in this worker, and gives memory that numpy and Arrow hold free back to the system."""
    packing = sys.modules.get("larkspur.llm.packing")
    if packing:
        packing.word_ids.cache_clear()
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A map of Arrow batches that starts without the tables of earlier stages and leaves no free memory in its worker.

    Workers serve the tasks of all stages, so what one stage keeps adds to what the next one needs."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        try:
            yield from run(batches)
        finally:
            _release()

    return mapped


SQL_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"  # for the oracles


def bit_set(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit set of 2^bits over a long column: 2^(bits - 6) words whatever the input, so it may be broadcast."""
    at = F.col(column).bitwiseAND((1 << bits) - 1)
    words = (df.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas())
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bit_set(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(np.uint64) & U64(len(table) * 64 - 1)
    return (table[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1
