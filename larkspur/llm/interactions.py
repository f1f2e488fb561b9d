"""Audit of filters that run one after another: what each order of them removes, and what each filter alone removes.

Rows are sorted by part and id and cut into id ranges. Within a range every filter has a posting list, the sorted places
of the rows that fail it. The union of the lists of every set of filters grows by one list at a time: a galloping search
(steps that double, then halve) finds the places of the added list among those held, the ids not found there are the
difference, and both are merged. A filter removes the size of its list less the union of those before it, so the unions
and differences of the 2^n sets hold all that every order needs; orders are laid out over the summed sizes.

Scale: one pass over the text gives the flags and two hashes; ids and flags alone are written and shuffled. Identical
texts meet by hash: their smallest id is an aggregate, kept only for texts found again, and joined to rows whose side can
be split. Ranges are dealt by part, id and text hash, so a part, or one id, in a third of all rows is spread over tasks;
a task holds `BLOCK` rows. Sizes are added up by Spark: (2^n + n 2^(n-1)) rows a part and range.

Defined cases: a null text is empty; a null part is the empty part; every row is a document of its own, repeated rows
included (they do not count as copies of each other, as their ids are equal); a row without an id has no smaller id and
is no other row's, so it passes the copy filter; a label holds if any row of `labels` with the id says so; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c

BLOCK = 1 << 17
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 2
_BLANKS = " \t\n\x0b\x0c\r"
_TOTAL = -1  # in place of a filter: the rows of the part; of a set of filters: how many fail any of it


# --- the five filters ---------------------------------------------------------------------------------------------


def text_filters(text: Column) -> dict[str, Column]:
    """Failing conditions of one text, without the copies (E)."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[ \t-\r]+"), lambda w: w != "")
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    return {"A": F.size(words) < MIN_WORDS,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_SHARE,
            "C": capitals.cast("long") * 100 > F.length(t).cast("long") * CAPITAL_SHARE,
            "D": t.rlike(r"[#$%&*|]")}


def copies_of_smaller(rows: DataFrame, flag: str) -> DataFrame:
    """rows (id, tk1, tk2, ...) with a flag: the same text has a smaller id."""
    first = rows.groupBy("tk1", "tk2").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > 1)
    first = c.materialize(first.select("tk1", "tk2", "first"), "repeated-texts")  # a plain table: the join's other side can be split
    joined = rows.join(first, ["tk1", "tk2"], "left")
    return joined.select(*rows.columns, F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias(flag))


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, tk1, tk2, A to E, good, toxic) of every row."""
    conditions = text_filters(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), *c.text_key(text_col),
                       *[v.alias(k) for k, v in conditions.items()])
    base = copies_of_smaller(c.materialize(base, "filter-flags"), "E")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = c.materialize(known.where(F.col("good") | F.col("toxic")), "filter-labels")
    never = F.lit(False)
    return base.join(known, "id", "left").select("id", "part", "tk1", "tk2", *"ABCDE", F.coalesce("good", never).alias("good"), F.coalesce("toxic", never).alias("toxic"))


# --- posting lists ------------------------------------------------------------------------------------------------


def gallop(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """First place in sorted `ids` that is not below each of the sorted keys.

    Every 32nd key is found first, by the same search; the keys after it start from its place and double their steps
    until they pass, then halve them.
    """
    if len(keys) <= 32:
        return np.searchsorted(ids, keys)
    place = np.repeat(gallop(ids, keys[::32]), 32)[:len(keys)]
    step = np.ones(len(keys), np.int64)
    n = len(ids)
    at = np.arange(len(keys))  # keys that have not passed yet
    while len(at):
        ahead = place[at] + step[at] - 1
        below = (ahead < n) & (ids[np.minimum(ahead, n - 1)] < keys[at]) if n else np.zeros(len(at), bool)
        at = at[below]
        place[at] += step[at]
        step[at] *= 2
    half = int(step.max())
    while half > 1:  # the place lies within step - 1 of where the search stopped
        half //= 2
        ahead = place + half - 1
        below = (step > half) & (ahead < n) & (ids[np.minimum(ahead, n - 1)] < keys)
        place[below] += half
    return place


def merge(held: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of two sorted lists of distinct ids, and what the second brings to it."""
    if not len(held) or not len(added):
        return (held if len(held) else added), added
    place = gallop(held, added)
    fresh = (place == len(held)) | (held[np.minimum(place, len(held) - 1)] != added)
    place, new = place[fresh], added[fresh]
    out = np.empty(len(held) + len(new), held.dtype)
    own = np.ones(len(out), bool)
    own[place + np.arange(len(new))] = False
    out[own], out[~own] = held, new
    return out, new


def range_sizes(flags: np.ndarray, marks: list[np.ndarray], part: np.ndarray, parts: int) -> np.ndarray:
    """Sizes within one id range: (set of filters, filter or total, part, count and marked counts).

    `flags` is filters x rows; `part` is the part's number of every row, in order.
    """
    n = len(flags)
    lists = [np.flatnonzero(f) for f in flags]
    out = np.zeros((1 << n, n + 1, parts, 1 + len(marks)), np.int64)

    def count(ids: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(part[i], minlength=parts) for i in (ids, *(ids[m[ids]] for m in marks))], 1)

    unions = {0: np.zeros(0, np.int64)}
    for held in range(1 << n):
        ids = unions.pop(held)
        out[held, n] = count(ids) if held else count(np.arange(len(part)))
        for f in range(n):
            if not held >> f & 1:
                both, fresh = merge(ids, lists[f])
                out[held, f] = count(fresh)
                unions.setdefault(held | 1 << f, both)
    return out


def _sizes(n: int, n_marks: int, block: int):
    names = ["part", "held", "filter", *(f"n{i}" for i in range(n_marks + 1))]
    held_of, filter_of = (x.ravel() for x in np.meshgrid(np.arange(1 << n), np.arange(n + 1), indexing="ij"))
    used = (filter_of == n) | (held_of >> np.minimum(filter_of, n - 1) & 1 == 0)
    filter_of = np.where(filter_of == n, _TOTAL, filter_of)

    def solve(rows: pa.Table) -> pa.RecordBatch:
        coded = rows.column(0).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        part, parts = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        cols = [rows.column(i).to_numpy() for i in range(1, 1 + n + n_marks)]
        sizes = range_sizes(np.stack(cols[:n]), cols[n:], part, parts).reshape(len(used), parts, -1)[used]
        per = int(used.sum())
        return pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(np.tile(np.arange(parts), per))), pa.array(np.repeat(held_of[used], parts), pa.int32()), pa.array(np.repeat(filter_of[used], parts), pa.int32()),
             *(pa.array(sizes[:, :, i].ravel()) for i in range(n_marks + 1))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size >= block:
                yield solve(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if size:
            yield solve(pa.Table.from_batches(waiting))

    return run


def set_sizes(rows: DataFrame, filters: str, marks: list[str], block: int = BLOCK) -> DataFrame:
    """(part, held, filter, n0, n1, ...): rows that fail the filter and none of the set `held` (bit i: filter i), and
    how many of them bear each mark; with filter -1, rows that fail any of the set (all rows for the empty set)."""
    c.ship_package(rows.sparkSession)
    ranges = c.materialize(rows, "flagged-rows").repartitionByRange("part", "id", "tk1").sortWithinPartitions("part", "id", "tk1")
    counts = [f"n{i}" for i in range(len(marks) + 1)]
    got = ranges.select("part", *filters, *marks).mapInArrow(
        _sizes(len(filters), len(marks), block), "part string, held int, filter int, " + ", ".join(f"{x} long" for x in counts))
    return got.groupBy("part", "held", "filter").agg(*[F.sum(x).alias(x) for x in counts])


# --- orders -------------------------------------------------------------------------------------------------------


def order_steps(filters: str) -> list[tuple]:
    """(order, step, filter's name, its number, set of the filters before it) of every order."""
    number = {f: i for i, f in enumerate(filters)}
    return [("".join(order), k + 1, f, number[f], sum(1 << number[g] for g in order[:k]))
            for order in itertools.permutations(filters) for k, f in enumerate(order)]


def audit(rows: DataFrame, filters: str = "ABCDE", marks: tuple[str, ...] = ("good", "toxic"), block: int = BLOCK) -> DataFrame:
    """One row per part, order and step. rows: (part, id, tk1, a boolean column for each filter letter and each mark).

    kept, removed, redundant, unique_fails, shapley, and `<mark>_lost` for every mark.
    """
    n = len(filters)
    sizes = c.materialize(set_sizes(rows, filters, list(marks), block), "set-sizes")
    orders = [math.factorial(bin(s).count("1")) * math.factorial(n - 1 - bin(s).count("1")) if s + 1 < 1 << n else 0 for s in range(1 << n)]
    weight = F.element_at(F.array(*[F.lit(x) for x in orders]), F.col("held") + 1)  # orders that put exactly this set first
    rest = F.col("held") == F.lit((1 << n) - 1) - F.expr("shiftleft(1, filter)")
    per_filter = sizes.where(F.col("filter") != _TOTAL).groupBy("part", "filter").agg(
        F.sum(F.when(F.col("held") == 0, F.col("n0"))).alias("fails"), F.sum(F.when(rest, F.col("n0"))).alias("unique_fails"), F.sum(F.col("n0") * weight).alias("shapley"))
    failing = sizes.where(F.col("filter") == _TOTAL)
    totals = failing.groupBy("part").agg(F.sum(F.when(F.col("held") == 0, F.col("n0"))).alias("rows"))
    unions = failing.select("part", "held", F.when(F.col("held") == 0, 0).otherwise(F.col("n0")).alias("gone"))
    steps = F.broadcast(rows.sparkSession.createDataFrame(order_steps(filters), "filter_order string, step int, name string, filter int, held int"))
    return (sizes.join(steps, ["held", "filter"]).join(per_filter, ["part", "filter"]).join(totals, "part").join(unions, ["part", "held"])
            .select("part", "filter_order", "step", (F.col("rows") - F.col("gone") - F.col("n0")).alias("kept"), F.col("n0").alias("removed"),
                    (F.col("fails") - F.col("n0")).alias("redundant"), "unique_fails", *[F.col(f"n{i + 1}").alias(f"{m}_lost") for i, m in enumerate(marks)], "shapley"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: `audit` of the five filters over whole documents, by source."""
    return audit(flagged(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels")))


ORACLE = r"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws, min(doc_id) over (partition by t) first from d),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
f as (select part, len(ws) < 200 a, 100 * len(list_distinct(ws)) < 50 * len(ws) b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) c,
             regexp_matches(t, '[#$%&*|]') d, coalesce(doc_id > first, false) e, coalesce(good, false) good, coalesce(toxic, false) toxic
      from w left join l using (doc_id)),
m as (select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end ||
             case when e then 'E' else '' end fails, good, toxic, count(*) n from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select p.x || q.x || r.x || s.x || t.x filter_order from x p, x q, x r, x s, x t
      where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s as (select filter_order, step, filter_order[step] f, filter_order[1:step - 1] earlier from (select filter_order, unnest(range(1, 6)) step from o)),
g as (select part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) hit, regexp_matches(fails, '[' || case when earlier = '' then '-' else earlier end || ']') gone from m, s),
r as (select part, filter_order, step, f, coalesce(sum(n) filter (where not hit and not gone), 0)::bigint kept,
             coalesce(sum(n) filter (where hit and not gone), 0)::bigint removed, coalesce(sum(n) filter (where hit and gone), 0)::bigint redundant,
             coalesce(sum(n) filter (where fails = f), 0)::bigint unique_fails, coalesce(sum(n) filter (where hit and not gone and good), 0)::bigint good_lost,
             coalesce(sum(n) filter (where hit and not gone and toxic), 0)::bigint toxic_lost
      from g group by all)
select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, f)::bigint shapley from r
"""
