"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles is reduced to `hashes` minima. Groups of minima are the bands that generate
candidates; the low `BITS` bits of every minimum, packed into a few longs, estimate a candidate's similarity by counting
differing fields and correcting for fields that agree by chance. Pairs that may reach the threshold are confirmed on
their full sets, and linked documents form components.

Scale: texts are read once for signatures and again for the full sets of those documents that some candidate needs
(found by a bit set of fixed size, then an exact join). Documents with equal sets are one class before anything is
paired, so groups of exact copies cost one row. Pairs within a bucket are never all formed. Every member meets the few
members of its bucket that share buckets with the most others, which links a family of copies to its origin in rows that
grow with the members; links are contracted to components. Buckets that still hold several components are resolved by a
prefix join: two sets that reach the threshold share one of their rarest shingles, where how many depends on both sizes,
so members outside a bucket's largest component look up only those. Any common order of shingles keeps this exact; rarity
is estimated by a count table of fixed size. No link between different components is lost, and no step needs more rows
than members x (pivots or prefix). Every step is written to the shared folder.

The chance that a pair at the threshold shares no band or fails the estimate is about `MISS`.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a text of fewer words than a
shingle is one shingle; repeated rows are copies; a null id is never a component's id unless all its members' are null;
columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larkspur.llm import common as c
from larkspur.llm.components import components

SHINGLE, PERCENT = 5, 80
HASHES, BITS = 512, 2
BAND_HASHES = 128  # the first of them make the bands
MISS, SIGMAS = 1e-6, 5.0
PIVOTS = 3
NEEDED_BITS = 25
RARITY_BITS = 20
SIZE_STEP = 1.04
_RANDOM = np.random.default_rng(20240229)
_XOR = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_FIELDS = 64 // BITS


def banding(percent: int, hashes: int = BAND_HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows of a band): the longest bands that miss a pair at the threshold with at most the given chance."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best or (hashes, 1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one after the other, and their number by row."""
    buf = c.lower_ascii(buf)
    starts, ends, rows = c.spans(buf, off, ~c.SPACES)
    words, counts = c.span_hashes(buf, starts, ends), np.diff(rows)
    grams = c.gram_hashes(words, k)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for r in np.flatnonzero(counts):
        n = counts[r]
        own = grams[rows[r]:rows[r + 1] - k + 1] if n >= k else c.mix(c.gram_hashes(words[rows[r]:rows[r + 1]], n) ^ c.U64(n))
        own = np.sort(own)
        own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        parts.append(own)
        sizes[r] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def _minima(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minima by hash function and non-empty row."""
    base = (values >> c.U64(32)).astype(np.uint32)
    full = sizes[sizes > 0]
    first = np.concatenate(([0], np.cumsum(full)[:-1])).astype(np.int64)
    out = np.empty((HASHES, len(full)), np.uint32)
    for i in range(HASHES):
        out[i] = np.minimum.reduceat((base ^ _XOR[i]) * _MUL[i], first)
    return out


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _pack(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima, packed: row x longs."""
    low = (_mix32(minima) & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    out = np.zeros((low.shape[1], HASHES // _FIELDS), np.uint64)
    for i in range(HASHES):
        out[:, i // _FIELDS] |= low[i] << c.U64(BITS * (i % _FIELDS))
    return out


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in c.blocks(batch.column(3)):
                values, sizes = shingle_sets(buf, off, k)
                full = np.flatnonzero(sizes)
                key, band, sig = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
                if len(full):
                    first = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    sums = [np.add.reduceat(c.mix(values ^ c.U64(s)), first) for s in (0x1234567, 0x7654321)]
                    minima = _minima(values, sizes)
                    wide = minima.astype(np.uint64)
                    buckets = np.stack([c.mix((wide[b * rows:(b + 1) * rows] * c._PLACES[:rows, None]).sum(0, dtype=np.uint64) ^ c.mix(np.full(1, b + 1, np.uint64))) for b in range(bands)], 1)
                    packed = _pack(minima)
                    keys = np.stack(sums, 1).astype("<u8")
                    for i, r in enumerate(full):
                        key[r], band[r], sig[r] = keys[i].tobytes(), buckets[i].view(np.int64), packed[i].view(np.int64)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(sizes), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))],
                    ["id", "rk1", "rk2", "n", "v", "bands", "sig"])

    return run


def _needed_sets(k: int, needed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = c.in_bit_set(needed.value, batch.column(0).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(hit))
            for lo, hi, buf, off in c.blocks(batch.column(2)):
                values, sizes = shingle_sets(buf, off, k)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values.view(np.int64)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["rk1", "rk2", "shingles"])

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for low bits that agree by chance."""
    ones = sum(1 << (BITS * i) for i in range(_FIELDS))
    ones -= (1 << 64) if ones >= 1 << 63 else 0
    differ = F.lit(0)
    for i in range(HASHES // _FIELDS):
        x = a[i].bitwiseXOR(b[i])
        any_bit = x
        for s in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(ones)))
    chance = 2.0**-BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def floor_estimate(percent: int) -> float:
    """Estimates below this are `SIGMAS` deviations from the threshold."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - SIGMAS * math.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets reach the threshold."""
    a = sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (pairs.join(a, "a").join(b, "b")
            .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
            .where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("a", "b"))


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose sizes and estimate allow the threshold."""
    pairs = pairs.distinct()
    a = classes.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga"))
    b = classes.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb"))
    return (pairs.join(a, "a").join(b, "b")
            .where(_possible("na", "nb", "ga", "gb", percent))
            .select("a", "b"))


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common elements of sets of a and b elements that reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _prefixes(percent: int, counts):
    """Lookups of the rarest shingles: (token, step, v, root, n, sig, probe). A probe goes to every step of sizes it can match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        log_step = np.log(SIZE_STEP)
        for batch in batches:
            tokens, steps, rows, probes = [], [], [], []
            values = batch.column(3)
            off = values.offsets.to_numpy()
            flat = values.values.to_numpy(zero_copy_only=False)
            probing = batch.column(2).to_numpy(zero_copy_only=False)
            for r in range(len(batch)):
                own = flat[off[r]:off[r + 1]]
                n = len(own)
                own = own[np.lexsort((own, table[own.view(np.uint64) & c.U64(len(table) - 1)]))]
                low, high = -(-percent * n // 100), 100 * n // percent
                keep = n - int(least_overlap(n, low, percent)) + 1
                tokens.append(own[:keep])
                steps.append(np.full(keep, int(np.log(n) / log_step)))
                rows.append(np.full(keep, r))
                probes.append(np.zeros(keep, bool))
                if probing[r]:
                    for step in range(int(np.log(low) / log_step), int(np.log(high) / log_step) + 1):
                        least = max(low, int(np.floor(SIZE_STEP**step * (1 - 1e-9))))  # smallest size of the step
                        keep = n - int(least_overlap(n, least, percent)) + 1
                        if keep > 0:
                            tokens.append(own[:keep])
                            steps.append(np.full(keep, step))
                            rows.append(np.full(keep, r))
                            probes.append(np.ones(keep, bool))
            if tokens:
                at = pa.array(np.concatenate(rows))
                own = [batch.column(i).take(at) for i in (0, 1, 4, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(steps).astype(np.int32)), *own, pa.array(np.concatenate(probes))],
                                                 ["token", "step", "v", "root", "n", "sig", "probe"])

    return run


def _possible(na: str, nb: str, ga: str, gb: str, percent: int) -> Column:
    """Sizes and estimate allow the threshold."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (estimate(F.col(ga), F.col(gb)) >= floor_estimate(percent))


def _prefix_pairs(rest: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components, one of them a probe, that share a shingle early enough to reach the
    threshold and whose estimate allows it."""
    spark = rest.sparkSession
    slot = F.col("token").bitwiseAND((1 << RARITY_BITS) - 1)
    table = sets.select(F.explode("shingles").alias("token")).groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(1 << RARITY_BITS, np.int32)
    counts[table["slot"].to_numpy(np.int64)] = table["n"].clip(upper=(1 << 31) - 1).to_numpy(np.int32)
    shared = spark.sparkContext.broadcast(counts)
    rows = (rest.groupBy("v").agg(F.first("root").alias("root"), F.max(~F.col("largest")).alias("probe")).join(sets, "v")
            .join(classes.select("v", "n", "sig"), "v").select("v", "root", "probe", "shingles", "n", "sig"))
    found = c.materialize(rows.mapInArrow(c.lean(_prefixes(percent, shared)), "token long, step int, v binary, root binary, n long, sig array<long>, probe boolean"), "prefixes")
    index = found.where(~F.col("probe")).select("token", "step", *[F.col(x).alias(f"w_{x}") for x in ("v", "root", "n", "sig")])
    return (found.where("probe").join(index, ["token", "step"]).where((F.col("root") != F.col("w_root")) & _possible("n", "w_n", "sig", "w_sig", percent))
            .select(F.least("v", "w_v").alias("a"), F.greatest("v", "w_v").alias("b")).distinct())


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, pivots: int = PIVOTS) -> DataFrame:
    """A row per document: rk1, rk2 (its key), id, n (shingles) and root, equal for linked documents and null for an empty set."""
    spark = docs.sparkSession
    c.ship_package(spark)
    bands, rows = banding(percent)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), *c.row_key(id_col, text_col), F.col(text_col).alias("text"))
    texts = source.select("rk1", "rk2", "text")
    signed = c.materialize(source.mapInArrow(c.lean(_signatures(shingle, bands, rows)), f"id {kind}, rk1 long, rk2 long, n long, v binary, bands array<long>, sig array<long>"), "signatures")
    classes = c.materialize(signed.where(F.col("v").isNotNull()).groupBy("v").agg(
        F.min(F.struct("rk1", "rk2")).alias("rk"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    every = classes.select("v", F.explode("bands").alias("bucket"))
    sizes = every.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = c.materialize(every.join(sizes, "bucket"), "members")
    central = members.groupBy("v").agg(F.sum("size").alias("meets"))
    order = Window.partitionBy("bucket").orderBy(F.desc("meets"), "v")
    ranked = members.join(central, "v").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots)
    first = c.materialize(ranked.select("bucket", F.col("v").alias("p")), "pivots")
    found = members.join(first, "bucket").where(F.col("p") != F.col("v")).select(F.least("p", "v").alias("a"), F.greatest("p", "v").alias("b"))
    tested = c.materialize(_candidates(found, classes, percent), "pairs")
    links = c.materialize(_confirm(tested, _sets(texts, classes, tested.select(F.col("a").alias("v")).union(tested.select("b")), shingle), percent), "links")
    roots = components(links)
    rest = c.materialize(_unsettled(members.where(F.col("size") > pivots + 1), roots), "rest")
    sets = _sets(texts, classes, rest.select("v"), shingle)
    more = c.materialize(_prefix_pairs(rest, classes, sets, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    late = c.materialize(_confirm(more, sets, percent), "links")
    if not late.isEmpty():
        roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(late))
    return signed.select("rk1", "rk2", "id", "n", "v").join(roots, "v", "left").select("rk1", "rk2", "id", "n", F.coalesce("root", "v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id it is linked with, directly or not), kept."""
    placed = classify(docs, id_col, text_col, shingle, percent)
    lowest = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("low"))
    return (placed.join(lowest, "root", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest id (null last), one row of it."""
    placed = classify(docs, id_col, text_col, shingle, percent)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "rk1", "rk2")
    lowest = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(place).alias("low")).select("low.rk1", "low.rk2")
    stay = lowest.union(placed.where(F.col("root").isNull()).select("rk1", "rk2").distinct())
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("__row")
    return docs.select(row, *c.row_key(id_col, text_col)).join(stay, ["rk1", "rk2"], "left_semi").groupBy("rk1", "rk2").agg(F.first("__row").alias("__row")).select("__row.*")


def _unsettled(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components; `largest` marks the component with the most members."""
    placed = rest.select("bucket", "v").join(roots, "v", "left").select("bucket", "v", F.coalesce("root", "v").alias("root"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    several = (sizes.groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("top"))
               .where(F.col("roots") > 1))
    return placed.join(several, "bucket").select("bucket", "v", "root", (F.col("root") == F.col("top")).alias("largest"))


def _sets(texts: DataFrame, classes: DataFrame, used: DataFrame, shingle: int) -> DataFrame:
    """(v, shingles) of the used classes, from one document of each."""
    wanted = c.materialize(classes.join(used.distinct(), "v", "left_semi").select("v", "rk.rk1", "rk.rk2"), "wanted")
    bits = texts.sparkSession.sparkContext.broadcast(c.bit_set(wanted, "rk1", NEEDED_BITS))
    some = texts.mapInArrow(c.lean(_needed_sets(shingle, bits)), "rk1 long, rk2 long, shingles array<long>")
    return c.materialize(some.join(wanted, ["rk1", "rk2"]).select("v", "shingles").dropDuplicates(["v"]), "sets")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: `near_duplicates` over whole documents with shingles of three words and a similarity of 0.85."""
    return near_duplicates(c.table(spark, sf_dir, "documents"), shingle=3, percent=85)
