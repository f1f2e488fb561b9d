"""Benchmark decontamination by winnowing.

Both sides keep the minimum hash of every `window` consecutive k-grams. Two texts that share `span` = k + window - 1
words share a window of k-grams, hence its minimum, so every shared span of that length has a fingerprint in common.
Fingerprints meet in a join and each hit is extended to both sides, word by word, as far as a shared span through this
fingerprint can reach; runs of `span` words or more count.

Scale: texts are read once. A bit set of fixed size (`filter_bits`) over the benchmark's fingerprints is broadcast, so
only fingerprints that may occur there are kept; the join itself is an ordinary shuffle join and exact at every size.
What is kept is written to the shared folder and read twice. Results depend on the text alone and are keyed by its
hash, so copies are resolved once. A hot fingerprint is a skewed row group on the document side of an inner join, which
adaptive execution splits; benchmark items with the same surrounding words are one row of that join.

Defined cases: null or wordless texts have no words and no hits; an item without words is ignored; an item of fewer
than `span` words is one window of its own length and is searched with k-grams of that length, all of them kept; a null
item id is the string `null`; repeated item ids count once; repeated documents each get their own row; columns besides
the id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import common as c

SPAN, K = 10, 4
FILTER_BITS = 26
_FP = pa.list_(pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("words", pa.list_(pa.string()))]))


def _winnow(grams: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost minimum of each run of `window` grams; rows are the grams [first, last)."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window):
        nxt = grams[j:j + n]
        less = nxt <= best
        np.copyto(best, nxt, where=less)
        place[less] = j
    inside = np.zeros(n + 1, np.int32)
    full = last - first >= window
    np.add.at(inside, first[full], 1)
    np.add.at(inside, last[full] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    found = starts + place[starts]
    return found[np.diff(found, prepend=-1) > 0]  # they never step back


def _prints(buf: np.ndarray, off: np.ndarray, span: int, k: int, lengths: tuple[int, ...], bits: np.ndarray | None,
            whole: bool) -> tuple[np.ndarray, list[list[dict]]]:
    """Words per row, and per row the kept fingerprints with the words around them.

    `whole` is the benchmark side: a short row gives one fingerprint of all its words. On the document side every
    n-gram of the `lengths` of short items is looked up.
    """
    buf = c.lower_ascii(buf)
    starts, ends, rows = c.spans(buf, off, c.ITEM_WORD)
    hashes, counts = c.span_hashes(buf, starts, ends), np.diff(rows)
    found: list[list[dict]] = [[] for _ in counts]

    def keep(pos: np.ndarray, fps: np.ndarray, size: int, reach: int) -> None:
        if bits is not None:
            hit = c.in_bit_set(bits, fps)
            pos, fps = pos[hit], fps[hit]
        owner = np.searchsorted(rows, pos, "right") - 1
        for p, fp, r in zip(pos.tolist(), c.signed(fps).tolist(), owner.tolist()):
            lo, hi = max(rows[r], p - reach), min(rows[r + 1], p + size + reach)
            words = [buf[starts[w]:ends[w]].tobytes().decode() for w in range(lo, hi)]
            found[r].append({"fp": fp, "pos": p - int(rows[r]), "lead": p - int(lo), "words": words})

    grams = c.gram_hashes(hashes, k)
    long = counts >= span
    keep_at = _winnow(grams, rows[:-1][long], rows[1:][long] - k + 1, span - k + 1)
    keep(keep_at, grams[keep_at], k, span - k)
    for n in lengths:
        grams = c.mix(c.gram_hashes(hashes, n) ^ c.U64(n))
        if whole:
            at = rows[:-1][counts == n]
        else:
            at = np.arange(len(grams))
            at = at[at + n <= rows[np.searchsorted(rows, at, "right")]]
        keep(at, grams[at], n, 0)
    return counts, found


def _mapper(keep_cols: list[str], text_col: str, span: int, k: int, lengths: tuple[int, ...], bits, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value if bits is not None else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, buf, off in c.blocks(texts):
                counts, found = _prints(buf, off, span, k, lengths, table, whole)
                part = batch.slice(lo, hi - lo)
                arrays = [part.column(part.schema.get_field_index(x)) for x in keep_cols]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(found, _FP)], [*keep_cols, "n_words", "prints"])

    return run


_PRINTS = "n_words long, prints array<struct<fp:long,pos:int,lead:int,words:array<string>>>"


def benchmark_prints(items: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """(fp, size, need, lead, words, items): a row for each fingerprint with different words around it."""
    source = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(_mapper(["item"], "text", span, k, tuple(range(1, span)), None, True), f"item string, {_PRINTS}")
    size = F.when(F.col("n_words") < span, F.col("n_words")).otherwise(k).cast("int")
    need = F.least(F.col("n_words"), F.lit(span)).cast("int")
    return (rows.select("item", size.alias("size"), need.alias("need"), F.inline("prints"))
            .groupBy("fp", "size", "need", "lead", "words").agg(F.collect_set("item").alias("items")))


def hit_spans(docs: DataFrame, bench: DataFrame, k: int = K) -> DataFrame:
    """Extended hits: (tk1, tk2, lo, hi, items), words lo to hi - 1 of a text."""
    d = (docs.where(F.size("prints") > 0).select("tk1", "tk2", F.inline("prints"))
         .select("tk1", "tk2", "fp", "pos", F.col("lead").alias("d_lead"), F.col("words").alias("d_words"))
         .dropDuplicates(["tk1", "tk2", "pos", "fp"]))
    b = bench.select("fp", "size", "need", F.col("lead").alias("b_lead"), F.col("words").alias("b_words"), "items")
    same = lambda x, y: x.eqNullSafe(y)

    def run(a, b):
        """Equal leading entries of two arrays."""
        first = F.array_position(F.zip_with(a, b, same), F.lit(False))
        return F.when(first == 0, F.size(a)).otherwise(first - 1)

    core = F.slice("d_words", F.col("d_lead") + 1, F.col("size")) == F.slice("b_words", F.col("b_lead") + 1, F.col("size"))
    left = run(F.reverse(F.slice("d_words", F.lit(1), F.col("d_lead"))), F.reverse(F.slice("b_words", F.lit(1), F.col("b_lead"))))
    tail = lambda x, lead: F.slice(x, F.col(lead) + F.col("size") + 1, F.lit(1 << 20))
    right = run(tail("d_words", "d_lead"), tail("b_words", "b_lead"))
    return (d.join(b, "fp").where(core)
            .select("tk1", "tk2", "pos", "size", "need", "items", left.alias("left"), right.alias("right"))
            .where(F.col("left") + F.col("size") + F.col("right") >= F.col("need"))
            .select("tk1", "tk2", (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + F.col("size") + F.col("right")).alias("hi"), "items"))


def contaminated_texts(docs: DataFrame, items: DataFrame, carry: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                       span: int = SPAN, k: int = K, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(every document: the carried columns, tk1, tk2, n_words; contaminated texts only: tk1, tk2, n_hit, items)."""
    spark = docs.sparkSession
    c.ship_package(spark)
    bench = c.materialize(benchmark_prints(items, item_id, item_text, span, k), "bench")
    lengths = tuple(sorted(r[0] for r in bench.where(F.col("need") < span).select("need").distinct().collect()))  # under `span` values
    shared = spark.sparkContext.broadcast(c.bit_set(bench, "fp", bits))
    source = docs.select(F.struct(*[F.col(f"`{x}`") for x in carry]).alias("carry"), *c.text_key(F.col(f"`{text_col}`")), F.col(text_col).alias("text"))
    schema = T.StructType([*source.schema.fields[:3], *T._parse_datatype_string(_PRINTS).fields])
    prints = c.materialize(source.mapInArrow(c.lean(_mapper(["carry", "tk1", "tk2"], "text", span, k, lengths, shared, False)), schema), "prints")
    hits = hit_spans(prints, bench, k)
    covered = (hits.select("tk1", "tk2", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("word")).distinct()
               .groupBy("tk1", "tk2").agg(F.count("*").alias("n_hit")))
    names = (hits.select("tk1", "tk2", F.explode("items").alias("item")).distinct()
             .groupBy("tk1", "tk2").agg(F.sort_array(F.collect_list("item")).alias("items")))
    return prints.select("carry", "tk1", "tk2", "n_words"), covered.join(names, ["tk1", "tk2"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    every, found = contaminated_texts(docs, items, [id_col], text_col, **options)
    return (every.join(found, ["tk1", "tk2"], "left")
            .select(F.col("carry").getField(id_col).alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.col("n_hit").isNotNull().alias("contaminated")))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the digest of `decontaminate` over whole documents and benchmark."""
    got = decontaminate(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"regexp_extract_all({c.SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
with d as (select doc_id, {_WORDS} w from documents),
i as (select item_id, {_WORDS} w from benchmark),
iw as (select distinct item_id, least(len(w), 10) n, w[p:p + least(len(w), 10) - 1] g
       from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) p from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select doc_id, p, n, w[p:p + n - 1] g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, sizes where len(w) >= n)),
hit as (select doc_id, p, n, item_id from dw join iw using (n, g)),
words as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(p, p + n)) from hit) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
          from (select distinct doc_id, cast(item_id as varchar) item_id from hit) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
