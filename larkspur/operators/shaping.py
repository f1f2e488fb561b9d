"""Greedy slate shaping as folds over the rows of a session, inside the session's own row.

A slate is an array of structs in rank order. Every rule takes such an array and returns it in its new order, so rules
chain without a shuffle and without Python; a choice that depends on rows already placed reads them from the state of
the fold. Rows bear item_id and score, and what the rule asks for: canonical_url, family_key, model_key, variant_key,
source_key, quality_ok, tokens, featured, retailer. Null keys and null flags match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.folds import add, fold, let, spread, tally
from larkspur.functions.numbers import js_round
from larkspur.functions.staging import by_key


@dataclass(frozen=True)
class ShapeOptions:
    """Default windows, caps and bounds of the shaping rules."""

    limit: int = 20
    hard_window: int = 8
    soft_window: int = 12
    soft_repeats: int = 1
    min_distance: float = 0.28
    min_gap: int = 4
    source_window: int = 12
    source_cap: int = 6
    model_window: int = 12
    model_cap: int = 1
    featured_every: int = 12
    retailer_cooldown: int = 1


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _nothing(rows: Column) -> Column:
    """An empty array of the rows' own type."""
    return F.slice(rows, 1, 0)


def overlap(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of distinct tokens, 0 where both are empty."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) > both, both / (F.size(a) + F.size(b) - both)).otherwise(0.0))


def closest(tokens: Column, rows: Column) -> Column:
    """Least style distance to rows of two tokens or more; null where there is none, or where the row itself has fewer."""
    told = F.filter(rows, lambda r: F.size(r["tokens"]) >= 2)
    return F.when(F.size(tokens) >= 2, js_round(F.array_min(F.transform(told, lambda r: 1.0 - overlap(tokens, r["tokens"]))), 4))


def _since(keys: Column, key: Column) -> Column:
    """How many places back the key was last placed (keys come newest first); null if never."""
    return F.nullif(F.array_position(keys, key), F.lit(0))


def _same(a: Column, b: Column, *keys: str) -> Column:
    hits = [F.coalesce(a[k] == b[k], F.lit(False)) for k in keys]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def near_duplicates(rows: Column, o: ShapeOptions) -> Column:
    """No family, model or variant twice in the hard window; in the soft window a few repeats that are of quality, far
    enough in style, and apart. What is held back comes at the end, spread by model."""
    def shape(all_rows):
        soft = F.greatest(F.lit(o.soft_window), F.least(F.size(all_rows), F.lit(max(0, o.limit) + o.soft_repeats)))

        def step(s, r):
            place = F.size(s["placed"]) + 1
            gap = F.least(_since(s["families"], r["family_key"]), _since(s["models"], r["model_key"]))
            twins = F.filter(s["placed"], lambda p: _same(p, r, "family_key", "model_key"))
            fit = (s["repeats"] < o.soft_repeats) & F.coalesce(r["quality_ok"], F.lit(False)) & (gap >= o.min_gap)
            far = F.coalesce(closest(r["tokens"], twins) >= o.min_distance, F.lit(True))
            shown = F.coalesce(F.array_contains(s["variants"], r["variant_key"]), F.lit(False))
            # 0: held back, 1: placed, 2: placed as a repeat
            verdict = (F.when(place > soft, 1).when(gap.isNull(), F.when((place <= o.hard_window) & shown, 0).otherwise(1))
                       .when(place <= o.hard_window, 0).when(fit & far, 2).otherwise(0))

            def moved(v):
                yes = v > 0
                return F.struct(
                    F.when(yes, add(s["placed"], r)).otherwise(s["placed"]).alias("placed"), F.when(yes, s["late"]).otherwise(add(s["late"], r)).alias("late"),
                    F.when(yes, F.concat(F.array(r["family_key"]), s["families"])).otherwise(s["families"]).alias("families"),
                    F.when(yes, F.concat(F.array(r["model_key"]), s["models"])).otherwise(s["models"]).alias("models"),
                    F.when(yes & (place <= o.hard_window), add(s["variants"], r["variant_key"])).otherwise(s["variants"]).alias("variants"),
                    (s["repeats"] + F.when(v == 2, 1).otherwise(0)).alias("repeats"))

            return let(verdict, moved)

        state = F.struct(_nothing(all_rows).alias("placed"), _nothing(all_rows).alias("late"), _none("string").alias("families"), _none("string").alias("models"),
                         _none("string").alias("variants"), F.lit(0).alias("repeats"))
        return F.aggregate(all_rows, state, step, lambda s: F.concat(s["placed"], spread(s["late"], lambda r: F.coalesce(r["model_key"], r["family_key"]))))

    return let(rows, shape)


def cap_keys(rows: Column, key: str, cap: int, window: int, limit: int) -> Column:
    """At most `cap` rows of a key while fewer than `window` rows (or the whole slate, if shorter than the limit) are
    placed; the others come at the end, spread by the key."""
    def shape(all_rows):
        reach = F.greatest(F.lit(window), F.least(F.size(all_rows), F.lit(max(0, limit))))

        def step(s, r):
            full = (F.size(s["placed"]) < reach) & (tally(s["keys"], r[key].cast("string")) >= cap)
            return let(F.coalesce(full, F.lit(False)), lambda late: F.struct(
                F.when(late, s["placed"]).otherwise(add(s["placed"], r)).alias("placed"), F.when(late, add(s["late"], r)).otherwise(s["late"]).alias("late"),
                F.when(late, s["keys"]).otherwise(add(s["keys"], r[key].cast("string"))).alias("keys")))

        state = F.struct(_nothing(all_rows).alias("placed"), _nothing(all_rows).alias("late"), _none("string").alias("keys"))
        return F.aggregate(all_rows, state, step, lambda s: F.concat(s["placed"], spread(s["late"], lambda r: r[key])))

    return let(rows, shape)


def featured_slots(rows: Column, limit: int, every: Column | int, cooldown: int) -> Column:
    """The first `limit` rows, featured ones at every n-th place only and not from a retailer served just before; where
    none fits the place is organic. It ends where no organic row is left."""
    def shape(all_rows):
        gap = F.greatest(F.lit(2), every if isinstance(every, Column) else F.lit(every))
        size = F.least(F.lit(max(0, limit)), F.size(all_rows))
        organic = F.filter(all_rows, lambda r: ~F.coalesce(r["featured"], F.lit(False)))
        promoted = F.filter(all_rows, lambda r: F.coalesce(r["featured"], F.lit(False)))
        places = F.slice(F.sequence(F.lit(1), F.lit(max(1, limit))), F.lit(1), size)

        def step(s, place):
            slot = (place % gap == 0) & (s["taken"] < F.floor(size / gap))
            fitting = F.filter(s["promoted"], lambda r: ~F.coalesce(F.array_contains(s["recent"], r["retailer"]), F.lit(False)))
            offer = F.when(slot, F.try_element_at(fitting, F.lit(1)))

            def choose(pick):
                own = F.when(pick.isNotNull(), pick).otherwise(F.try_element_at(s["organic"], F.size(s["out"]) - s["taken"] + 1))
                won = pick.isNotNull()
                return F.struct(
                    F.when(s["open"] & own.isNotNull(), add(s["out"], own)).otherwise(s["out"]).alias("out"), s["organic"].alias("organic"),
                    F.when(won, F.filter(s["promoted"], lambda r: r["item_id"] != pick["item_id"])).otherwise(s["promoted"]).alias("promoted"),
                    F.when(won & pick["retailer"].isNotNull(), F.slice(F.concat(F.array(pick["retailer"]), s["recent"]), 1, cooldown)).otherwise(s["recent"]).alias("recent"),
                    (s["taken"] + F.when(won, 1).otherwise(0)).alias("taken"), (s["open"] & own.isNotNull()).alias("open"))

            return F.when(s["open"], let(offer, choose)).otherwise(s)

        state = F.struct(_nothing(all_rows).alias("out"), organic.alias("organic"), promoted.alias("promoted"), _none("string").alias("recent"), F.lit(0).alias("taken"), F.lit(True).alias("open"))
        return F.aggregate(places, state, step, lambda s: s["out"])

    return let(rows, shape)


def accept(rows: Column, cap: int, head: int = 12, first: int = 4, min_distance: float | None = None) -> Column:
    """Rows in order up to `cap`: a canonical url once, a family or model once among the first `head` accepted, and, if a
    distance is given, none of the first few too close in style to one before it."""
    def step(s, r):
        n = F.size(s["out"])
        known = lambda x: F.coalesce(F.array_contains(s["out"][x], r[x]), F.lit(False))
        bad = (n >= cap) | known("canonical_url") | ((n < head) & (known("family_key") | known("model_key")))
        if min_distance is not None:
            bad = bad | ((n < first) & F.coalesce(closest(r["tokens"], s["out"]) < min_distance, F.lit(False)))
        return {"out": F.when(bad, s["out"]).otherwise(add(s["out"], r))}

    return let(rows, lambda all_rows: fold(all_rows, {"out": _nothing(all_rows)}, step, lambda s: s["out"]))


def mmr(rows: Column, lam: float = 0.95, top_n: int = 80, need: int | None = None) -> Column:
    """Maximal marginal relevance over the first `top_n` rows, scores spread over 0 to 1 among them; the tail stays.

    Ties go to the more relevant row, then to the earlier one. Where only the first `need` rows will be read, no more are
    chosen and none follow.
    """
    def shape(all_rows):
        head = F.slice(all_rows, 1, max(1, top_n))
        scores = F.transform(head, lambda r: F.coalesce(r["score"].cast("double"), F.lit(0.0)))

        def relevant(low, high):
            return F.transform(head, lambda r, i: F.struct(
                F.when(high > low, (F.coalesce(r["score"].cast("double"), F.lit(0.0)) - low) / (high - low)).otherwise(0.0).alias("relevance"), (-i).alias("turn"), F.lit(0.0).alias("near"), r.alias("row")))

        def step(s, _):
            worth = lambda x: lam * x["relevance"] - (1.0 - lam) * x["near"]
            best = F.array_max(F.transform(s["left"], lambda x: F.struct(worth(x).alias("worth"), x["relevance"].alias("relevance"), x["turn"].alias("turn"))))

            def taken(turn):
                pick = F.element_at(F.filter(s["left"], lambda x: x["turn"] == turn), 1)
                return let(pick, lambda p: F.struct(
                    add(s["out"], p["row"]).alias("out"),
                    F.transform(F.filter(s["left"], lambda x: x["turn"] != turn), lambda x: F.struct(
                        x["relevance"].alias("relevance"), x["turn"].alias("turn"), F.greatest(x["near"], overlap(x["row"]["tokens"], p["row"]["tokens"])).alias("near"),
                        x["row"].alias("row"))).alias("left")))

            return let(best["turn"], taken)

        left = let(scores, lambda v: let(F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")), lambda b: relevant(b["low"], b["high"])))
        start = F.struct(_nothing(all_rows).alias("out"), left.alias("left"))
        if need is not None and need <= top_n:
            return F.aggregate(F.slice(head, 1, need), start, step, lambda s: s["out"])
        return F.aggregate(head, start, step, lambda s: F.concat(s["out"], F.slice(all_rows, F.lit(max(1, top_n) + 1), F.size(all_rows))))

    return let(rows, lambda all_rows: F.when((F.size(all_rows) > 1) & F.lit(lam < 1), shape(all_rows)).otherwise(all_rows))


def explore(rows: Column, session: Column, rate: Column, limit: int, seed: int = 0) -> Column:
    """The first `limit` rows with about rate * limit of them swapped for rows of the next `limit`; seeded per session.

    The fraction of a row is settled by a seeded draw; both sides are numbered in seeded order and paired by number."""
    seeded = lambda *parts: F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)
    draw = F.conv(F.substring(seeded(session, F.lit("draw")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    def shape(all_rows):
        base, more = F.slice(all_rows, 1, limit), F.slice(all_rows, limit + 1, limit)
        want = js_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)) * F.size(base), 9)
        count = (F.floor(want) + F.when(draw < want - F.floor(want), 1).otherwise(0)).cast("int")
        shuffled = lambda x: F.array_sort(F.transform(x, lambda r, i: F.struct(seeded(session, r["item_id"]).alias("by"), i.alias("at"))))

        def swap(s):
            gone = F.transform(F.slice(s["base"], F.lit(1), F.least(s["count"], F.size(s["more"]))), lambda x: x["at"])
            return let(gone, lambda g: F.transform(base, lambda r, i: F.when(
                F.array_contains(g, i), F.element_at(more, F.element_at(s["more"], F.array_position(g, i).cast("int"))["at"] + 1)).otherwise(r)))

        return let(F.struct(shuffled(base).alias("base"), shuffled(more).alias("more"), count.alias("count")), swap)

    return let(rows, shape)


def shape_slate(rows: Column, o: ShapeOptions, every: Column | int | None = None) -> Column:
    """All shaping rules in their order."""
    sources = lambda x: cap_keys(x, "source_key", o.source_cap, o.source_window, o.limit)
    organic = near_duplicates(sources(near_duplicates(rows, o)), o)
    served = featured_slots(organic, o.limit, o.featured_every if every is None else every, o.retailer_cooldown)
    return cap_keys(near_duplicates(sources(served), o), "model_key", o.model_cap, o.model_window, o.limit)


# ---- slates as rows ------------------------------------------------------------------------------------------

SLATE_COLUMNS = ("item_id", "score", "canonical_url", "family_key", "model_key", "variant_key", "source_key", "quality_ok", "tokens",
                 "featured", "retailer")


def slate_rows(ranked: DataFrame) -> DataFrame:
    """(session_id, rows): structs in rank order. The input is already cut to a rank window."""
    cols = [c for c in SLATE_COLUMNS if c in ranked.columns]
    packed = by_key(ranked, "session_id").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*cols).alias("row")))).alias("_s"))
    return packed.select("session_id", F.transform("_s", lambda s: s["row"]).alias("rows"))


def unpack(slates: DataFrame, *extra: str) -> DataFrame:
    """(session_id, position, item_id, score) in the slate's order."""
    return slates.select("session_id", F.posexplode("rows").alias("_p", "r")).select(
        "session_id", (F.col("_p") + 1).alias("position"), "r.item_id", "r.score", *[F.col("r")[x].alias(x) for x in extra])


def reorder(slates: DataFrame, rule) -> DataFrame:
    """Slates in the order that a rule of rows gives."""
    return slates.withColumn("rows", rule(F.col("rows")))
