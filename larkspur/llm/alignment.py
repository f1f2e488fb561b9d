"""Alignment of two tokenizers over the same texts: shared boundaries, linked tokens, and how common each link is.

Tokens of a block of texts are flat Arrow lists with parent indices; segmented cumulative sums of their byte lengths give
every token's end within its text. An Acero hash join on (text, end) brings the ends of both tokenizers together: ends
that both have cut a text into groups, and between two neighbouring ends, whichever side they come from, lies one pair of
overlapping tokens, a link. `Table.group_by` counts the links of a document by pair of ids, and those counts again for a
whole task; Spark adds up the tasks' partial counts.

Scale: texts are tokenized once, in the pass that also writes each document's pairs with their counts; a long text is
handled in pieces, cut at a space after a printable ASCII character and before a letter or digit, where neither joins. Of the pairs' counts those
that hold a 2^-20 part of all links or more, 2^20 at most whatever the input, are broadcast; a document's other pairs are
rows that meet their counts in a join, where no key holds more than that part. A pair id's best count is an aggregate
over pairs. A task holds a block of text, one document's pairs, and `PARTIAL` counts.

Defined cases: a text that is null, empty, or not given back byte for byte (after the leading space) by the tokens of
both has no tokens and all its figures are 0, its groups the empty string; repeated rows count each; ties for the best
count are all best; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c
from larkspur.session import unique_dir

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE, BLOCK, PARTIAL = 1 << 16, 1 << 19, 1 << 18
SHARE = 1 << 20  # pairs with a count of at least 1 / SHARE of all links are broadcast
# Fixed value: how a byte-level tokenizer splits text into words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"[!-~] (?=[A-Za-z0-9])")


def vocabulary_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text, cut after every `size` characters at the next place where the space that is left out may lead a text."""
    out, at = [], 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        out.append(text[at:cut.start() + 1])
        at = cut.end()
    return [*out, text[at:]]


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists, and the offsets of each."""
    off = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(off[-1])), off


class ByteTokens:
    """Byte-level BPE, of a space and the text; its merges are tried in the order of their ids."""

    def __init__(self, path: str):
        model = json.load(open(path))["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        tokens = {bytes(byte[ch] for ch in token): i for token, i in model["vocab"].items()}
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merged]
        if made != sorted(made):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        import tiktoken

        self.encoding = tiktoken.Encoding("larkspur", pat_str=WORDS, mergeable_ranks=tokens, special_tokens={})
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.encoding.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        off = np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))
        return (np.concatenate(got) if got else np.zeros(0)).astype(np.int64), off


class PieceTokens:
    """Pieces with byte fallback; the tokenizer puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError(f"{path}: a piece holds a space behind other characters, so texts cannot be cut at spaces")
        self.bytes = [bytes([int(name[1:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.model.encode(texts, num_threads=1))


@lru_cache(maxsize=1)
def tokenizers(first: str, second: str):
    pair = ByteTokens(vocabulary_path(first)), PieceTokens(vocabulary_path(second))
    return [(t, pa.array(t.bytes, pa.large_binary()), pa.array([len(x) for x in t.bytes], pa.int64())) for t in pair]


def faithful(words: pa.Array, ids: np.ndarray, off: np.ndarray, sizes: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Texts whose tokens' bytes, joined, are a space and the text."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    ok = total[off[1:]] - total[off[:-1]] == np.array([len(w) + 1 for w in wanted], np.int64)
    if ok.any():
        take = np.repeat(ok, np.diff(off))
        got, _ = c.raw(words.take(pa.array(ids[take])))
        want = np.frombuffer(b"".join(b" " + w for w, good in zip(wanted, ok) if good), np.uint8)
        length = np.array([len(w) + 1 for w, good in zip(wanted, ok) if good])
        if len(got) != len(want):
            raise ValueError("token lengths and token bytes differ")
        ok[ok] = np.add.reduceat(got != want, np.cumsum(length) - length) == 0
    return ok


def token_ends(tokens: pa.ListArray, sizes: pa.Array) -> pa.Array:
    """(text, end) of every token as one number: text << 40 | bytes of the text up to the token's end."""
    ids, parent = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    running = pc.cumulative_sum(pc.take(sizes, ids))
    first = np.asarray(tokens.offsets)[:-1]
    before = np.concatenate(([0], np.asarray(running)))[first]  # bytes of all texts before each text
    return pc.add(pc.subtract(running, pc.take(pa.array(before), parent)), pc.shift_left(pc.cast(parent, pa.int64()), 40))


def join_ends(a: pa.Array, b: pa.Array) -> pa.Table:
    """All ends in order: key, and the number of the token of each side that ends there, or null."""
    left = pa.table({"key": a, "a": pa.array(np.arange(len(a)))})
    right = pa.table({"key": b, "b": pa.array(np.arange(len(b)))})
    return left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()


def _joined(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids as decimal text, with commas, of every group of tokens that ends after one of the given tokens."""
    off = pa.array(np.concatenate(([0], ends + 1)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(off, pc.cast(pa.array(ids), pa.string())), ",")


class Aligned:
    """Links of a block of faithful texts, with the counts of each text."""

    def __init__(self, a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray, a_sizes: pa.Array, b_sizes: pa.Array, width: int):
        lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)) for ids, off in ((a, a_off), (b, b_off))]
        ends = join_ends(token_ends(lists[0], a_sizes), token_ends(lists[1], b_sizes))
        both = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"])).to_numpy()
        # the token over each stretch between ends is the next one of its side to end
        self.a_at, self.b_at = (pc.fill_null_backward(ends[x]).combine_chunks().to_numpy(zero_copy_only=False) for x in "ab")
        self.text = ends["key"].to_numpy() >> 40
        self.pair = a[self.a_at] * width + b[self.b_at]
        closed = np.flatnonzero(both)
        self.groups = pc.binary_join_element_wise(_joined(a, self.a_at[closed]), _joined(b, self.b_at[closed]), "|")
        self.group_text = self.text[closed]

    def text_groups(self, n: int) -> tuple[list[str], np.ndarray]:
        """Groups of every text in one string, and how many there are."""
        count = np.bincount(self.group_text, minlength=n)
        off = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(off, self.groups), ";").to_pylist(), count

    def pair_counts(self, owner: np.ndarray) -> pa.Table:
        """(owner, pair, n), where owner[i] stands for text i."""
        links = pa.table({"owner": owner[self.text], "pair": self.pair})
        return links.group_by(["owner", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["owner", "pair", "n"])


def add_counts(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    return pa.concat_tables([t.select([*keys, "n"]) for t in tables]).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


_KINDS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "groups": pa.string(),
          "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}


def _tokenize(first: str, second: str, keep_groups: bool, piece: int, block: int, partial: int):
    """Rows of documents, and rows without a key that hold partial counts of the task."""

    def align_rows(texts: list[str | None], tools, width: int) -> tuple[list[pa.Array], pa.Table | None]:
        (one, one_bytes, one_sizes), (two, two_bytes, two_sizes) = tools
        n = len(texts)
        parts = [(r, p) for r, t in enumerate(texts) if t for p in pieces(t, piece)]
        whole = np.array([bool(t) for t in texts], bool)
        blocks, at = [], 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (size < block or end == at):
                size += len(parts[end][1])
                end += 1
            blocks.append(parts[at:end])
            at = end
        encoded = []
        for group in blocks:
            own, given = [p for _, p in group], [p.encode() for _, p in group]
            row = np.array([r for r, _ in group])
            (a, a_off), (b, b_off) = one.encode(own), two.encode(own)
            good = np.ones(len(group), bool)
            for ids, off, words, sizes in ((a, a_off, one_bytes, one_sizes), (b, b_off, two_bytes, two_sizes)):
                good &= faithful(words, ids, off, pc.take(sizes, pa.array(ids)).to_numpy(), given)
            whole[row[~good]] = False
            encoded.append((row, a.astype(np.int32), a_off, b.astype(np.int32), b_off))
        figures = np.zeros((4, n), np.int64)
        digests = [hashlib.sha256() if w else None for w in whole]
        kept: list[list[str]] = [[] for _ in texts]
        counts: list[pa.Table] = []
        for row, a, a_off, b, b_off in encoded:
            stay = whole[row]
            if not stay.any():
                continue
            own = row[stay]
            a, b = (x[np.repeat(stay, np.diff(off))].astype(np.int64) for x, off in ((a, a_off), (b, b_off)))
            a_len, b_len = np.diff(a_off)[stay], np.diff(b_off)[stay]
            found = Aligned(a, np.concatenate(([0], np.cumsum(a_len))), b, np.concatenate(([0], np.cumsum(b_len))), one_sizes, two_sizes, width)
            groups, n_groups = found.text_groups(len(own))
            links = np.bincount(found.text, minlength=len(own))
            for figure, value in zip(figures, (a_len, b_len, n_groups, links)):
                np.add.at(figure, own, value)
            fresh = np.concatenate(([True], own[1:] != own[:-1]))  # later pieces of a text in this block go behind a semicolon
            for r, text, lead in zip(own.tolist(), groups, (fresh & ~np.isin(own, [x for x, k in enumerate(kept) if k])).tolist()):
                digests[r].update((text if lead else ";" + text).encode())
                kept[r] = [*kept[r], text] if keep_groups else [""]
            counts.append(found.pair_counts(own))
            if len(counts) > 8:
                counts = [add_counts(counts, ["owner", "pair"])]
        table = add_counts(counts, ["owner", "pair"]).sort_by("owner").combine_chunks() if counts else None
        per = np.bincount(table["owner"].to_numpy(), minlength=n) if table else np.zeros(n, np.int64)
        off = pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32())
        pairs, sums = (table[x].combine_chunks() if table else pa.array([], pa.int64()) for x in ("pair", "n"))
        cols = [*(pa.array(x) for x in figures), pa.array([d.hexdigest() if d else "" for d in digests]),
                pa.array([";".join(k) for k in kept] if keep_groups else [None] * n, pa.string()),
                pa.ListArray.from_arrays(off, pairs), pa.ListArray.from_arrays(off, sums)]
        return cols, table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(first, second)
        width = len(tools[1][1])
        held, names = None, ["row", "id", *_KINDS]

        def counted(table: pa.Table, kind: pa.DataType) -> pa.RecordBatch:
            off = np.append(np.arange(0, len(table), 1 << 14), len(table))
            n = len(off) - 1
            pairs, sums = (pa.ListArray.from_arrays(pa.array(off, pa.int32()), table[x].combine_chunks()) for x in ("pair", "n"))
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, kind), *(pa.nulls(n, t) for t in list(_KINDS.values())[:-2]), pairs, sums], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(1).type
            for lo, hi, _, _ in c.blocks(batch.column(2), block):
                part = batch.slice(lo, hi - lo)
                cols, table = align_rows(part.column(2).to_pylist(), tools, width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names)
                if table:
                    held = add_counts([table] if held is None else [held, table], ["pair"])
                    if len(held) > partial:
                        yield counted(held, kind)
                        held = None
        if held is not None:
            yield counted(held, kind)

    return run


def _look_up(known):
    """Sums over the links of common pairs, and the other pairs."""
    names = ["row", "n_best", "count_sum", "pairs", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals, best = known.value
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.slice(lo, 500)
                n = len(batch)
                pair, times = (pc.list_flatten(batch.column(i)).to_numpy() for i in (1, 2))
                row = pc.list_parent_indices(batch.column(1)).to_numpy()
                at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                sums = np.zeros(n, np.int64)
                np.add.at(sums, row[hit], totals[at[hit]] * times[hit])
                top = np.bincount(row[hit], weights=times[hit] * best[at[hit]], minlength=n).astype(np.int64)
                off = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[~hit], minlength=n)))), pa.int32())
                rest = [pa.ListArray.from_arrays(off, pa.array(x[~hit])) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top), pa.array(sums), *rest], names)

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = FIRST, second: str = SECOND, keep_groups: bool = False,
          share: int = SHARE, piece: int = PIECE, block: int = BLOCK, partial: int = PARTIAL) -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups), and the
    corpus-wide counts (a, b, n, best) of linked ids. Tokenizers are names of public files or absolute paths."""
    spark = docs.sparkSession
    c.ship_package(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, counts array<long>"
    tokens = source.mapInArrow(_tokenize(first, second, keep_groups, piece, block, partial), f"row long, id {kind}, {kinds}")
    path = unique_dir(spark, "aligned")
    tokens.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(tokens.schema).parquet(path)
    one = tokens.where(F.col("row").isNotNull())
    width = len(PieceTokens(vocabulary_path(second)).bytes)
    spread = tokens.where(F.col("row").isNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    pairs = spread.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
    pairs = c.materialize(pairs.select("pair", (F.col("pair") % width).alias("b"), "n"), "pair-counts")
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    pairs = c.materialize(pairs.join(top, "b").select("pair", F.expr(f"pair div {width}").alias("a"), "b", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    links = pairs.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * share >= links
    table = pairs.where(common).select("pair", "n", "best").toPandas().sort_values("pair")  # `share` rows at most
    known = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    summed = c.materialize(one.select("row", "pairs", "counts").mapInArrow(_look_up(known), "row long, n_best long, count_sum long, pairs array<long>, counts array<long>"), "link-sums")
    rare = summed.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("times"))
    rare = rare.join(pairs.where(~common), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best2"), F.sum(F.col("n") * F.col("times")).alias("sum2"))
    sums = summed.select("row", "n_best", "count_sum").join(rare, "row", "left")
    got = one.drop("pairs", "counts").join(sums, "row").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("best2", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("sum2", F.lit(0))).alias("count_sum"), "groups_sha256", *(["groups"] if keep_groups else []))
    return got, pairs.select("a", "b", "n", "best")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the documents of `align` over whole `documents`."""
    return align(c.table(spark, sf_dir, "documents"))[0]
