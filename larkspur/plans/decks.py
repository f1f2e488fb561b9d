"""Deck job: from weights, items, swipes and cohorts to a shaped slate for every session.

A session's facts (weights, swipes, segments, cohort list) meet once, by session; from there on a deck is built inside the
session's row, as array values: queues, gates, acceptance, scores, re-ranking, exploration and shaping are expressions of
one projection after the other, without a shuffle and without Python. What is read of the catalog is bounded by the fetch
limit of the two recency lists and travels as one array value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.folds import let
from larkspur.functions.numbers import js_round
from larkspur.functions.staging import by_key, pin
from larkspur.functions.hashing import string_hash32
from larkspur.operators import filters as G
from larkspur.operators import ranking as R
from larkspur.operators import shaping as S
from larkspur.operators.preferences import PRICE_BOUNDS, feature_keys


@dataclass(frozen=True)
class DeckOptions:
    """Limits and rates of the deck."""

    limit: int = 20
    pool: int = 360
    cap: int = 240
    head: int = 12  # accepted rows among which a family or model comes once
    first: int = 4  # rows of an onboarded session's first slate that keep a distance in style
    first_distance: float = 0.4
    recycle_days: int = 7
    cohort_items: int = 80
    alpha: float = 0.7
    cold_alpha: float = 0.2
    mmr_lambda: float = 0.95
    mmr_top: int = 80
    exploration: float = 0.08
    seed: int = 7
    contextual_first: bool = True
    shape: S.ShapeOptions = field(default_factory=S.ShapeOptions)


# ---- what a deck reads of an item and of a session ---------------------------------------------------------


def _column(items: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in items.columns else F.lit(None).cast(kind)


def deck_items(items: DataFrame, bounds=PRICE_BOUNDS) -> DataFrame:
    """(item_id, updated_day, row) of items that may be displayed: active, not taken out of the catalog, with images."""
    own = lambda name, kind="string": _column(items, name, kind)
    shown = F.col("is_active") & G.included(own("catalog_included", "boolean")) & G.image_gate(
        F.col("image_count"), F.coalesce(own("issues", "array<string>"), F.array().cast("array<string>")), own("images_validated", "boolean"), own("valid_image_count", "int"))
    keyed = R.with_item_keys(items.where(shown))
    url = own("canonical_url")
    row = F.struct(
        "item_id", F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat(F.lit("item:"), F.col("item_id").cast("string"))).alias("unique_key"),
        feature_keys(items, bounds).alias("keys"), "family_key", "model_key", "variant_key", F.col("source_id").cast("string").alias("source_key"),
        F.coalesce(F.col("creative_score") >= 60, F.col("image_count") >= 2).alias("quality_ok"), R.style_tokens(items).alias("tokens"), F.col("retailer").cast("string").alias("retailer"),
        G.surface_gate(F.col("title"), own("decision"), own("category")).alias("on_surface"), F.coalesce(own("scene_type") == "studio_cutout", F.lit(False)).alias("cutout"),
        own("price_amount", "double").alias("price"), own("size_class").alias("size_class"), own("color_family").alias("color_family"), G.facet(items, "seat_bucket").alias("seat_bucket"),
        G.facet(items, "sub_category").alias("sub_category"), own("modular", "boolean").alias("modular"), own("small_space", "boolean").alias("small_space"))
    return keyed.select("item_id", "updated_day", row.alias("row"))


def offers(promoted: DataFrame, campaigns: DataFrame, products: DataFrame) -> DataFrame:
    """(item_id, offer) of promoted items: the segment that must match, null for a plain promotion; offers of campaigns
    that do not run, or do not list the item, drop. promoted: (item_id, campaign_id); campaigns: running ones."""
    sets = products.select("campaign_id", F.lit(True).alias("_set")).distinct()
    rows = (promoted.join(campaigns.select("campaign_id", "segment_id", "product_mode"), "campaign_id", "left").join(sets, "campaign_id", "left")
            .join(products.select("campaign_id", "item_id", F.lit(True).alias("_listed")).dropDuplicates(), ["campaign_id", "item_id"], "left"))
    restricted = F.col("product_mode").isin("selected", "auto") & F.col("_set").isNotNull()
    fits = F.col("campaign_id").isNull() | (F.col("segment_id").isNotNull() & (~restricted | F.col("_listed").isNotNull()))
    return rows.where(fits).select("item_id", F.struct("campaign_id", "segment_id").alias("offer"))


def session_facts(sessions: DataFrame, weights: DataFrame, swipes: DataFrame, matches: DataFrame, cohorts: DataFrame, shown: DataFrame,
                  as_of: Column, o: DeckOptions) -> DataFrame:
    """Sessions with their weights as a map, preferred keys, confidence, swipes, matching segments and cohort list.

    Everything but the cohort lists is grouped by session, so these groups and their join share one layout.
    """
    w, live = F.col("weight"), F.col("weight") > 0
    known = weights.groupBy("session_id").agg(
        F.map_from_entries(F.collect_list(F.when(w != 0, F.struct("key", "weight")))).alias("weights"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(live, F.struct((-w).alias("by"), "key")))), lambda x: x["key"]), 1, 14).alias("preferred"),
        F.coalesce(F.max(F.when(live, w)).cast("double") / F.sum(F.when(live, w)).cast("double"), F.lit(0.0)).alias("confidence"))
    recent = F.col("ts") >= as_of - F.make_dt_interval(F.lit(o.recycle_days))
    swiped = swipes.groupBy("session_id").agg(F.count("*").alias("n_swipes"), F.collect_set(F.when(recent, F.col("item_id"))).alias("seen"))
    segments = matches.groupBy("session_id").agg(F.collect_set("segment_id").alias("segments"))
    lists = (cohorts.where(F.col("rank") <= o.cohort_items).join(shown.select("item_id", "row"), "item_id").groupBy("pick_hash")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "normalized_score", "row"))).alias("cohort")))
    facts = sessions.join(known, "session_id", "left").join(swiped, "session_id", "left").join(segments, "session_id", "left").join(lists, "pick_hash", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    item = shown.schema["item_id"].dataType.simpleString()
    segment = matches.schema["segment_id"].dataType.simpleString()
    return facts.withColumns({
        "preferred": F.coalesce("preferred", none("string")), "confidence": F.coalesce("confidence", F.lit(0.0)), "n_swipes": F.coalesce("n_swipes", F.lit(0)),
        "seen": F.coalesce("seen", none(item)), "segments": F.coalesce("segments", none(segment)), "cohort": F.coalesce("cohort", F.slice("cohort", 1, 0), none(lists.schema["cohort"].dataType.elementType.simpleString()))})


# ---- queues -------------------------------------------------------------------------------------------------


def passes(r: Column) -> Column:
    """The session's own facets and onboarding constraints: soft none, medium seats and room, hard the budget as well."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    stage = G.onboarding_stage(F.col("n_swipes"))
    wish = lambda name: F.col(f"want_{name}").isNull() | yes(r[name] == F.col(f"want_{name}"))
    subs = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v) for v in x]) for kv in G.SEAT_SUBCATEGORIES.items() for x in kv])
    seats = F.col("want_seat_bucket").isNull() | F.when(r["seat_bucket"].isNotNull(), r["seat_bucket"] == F.col("want_seat_bucket")).otherwise(
        yes(F.array_contains(subs[F.col("want_seat_bucket")], r["sub_category"])))
    room = (~yes(F.col("modular_only")) | yes(r["modular"])) & (~yes(F.col("want_small_space")) | yes(r["small_space"]))
    low, high = F.col("budget_min").isNull() | (r["price"] >= F.col("budget_min")), F.col("budget_max").isNull() | (r["price"] <= F.col("budget_max"))
    return wish("size_class") & wish("color_family") & ((stage == "soft") | (seats & room & ((stage != "hard") | r["price"].isNull() | (low & high))))


def queue_lists(facts: DataFrame, pool: DataFrame, salt: str = "") -> DataFrame:
    """Adds `items`, the rows this session may be shown, and `queues`: for each queue, in the order of the quota pass,
    places in them."""
    size = pool.agg(F.count("position")).scalar()
    listed = pool.agg(F.array_sort(F.collect_list(F.struct("item_id", "position", "promoted_rank", "catalog_rank", "row", "offer")))).scalar()
    points = lambda r: F.aggregate(F.filter(r["keys"], lambda k: F.array_contains("preferred", k)), F.lit(0), lambda acc, k: acc + R.overlap_points(k))
    own = ("item_id", "position", "promoted_rank", "catalog_rank", "row", "offer")
    near = F.transform(F.filter("_pool", lambda p: passes(p["row"])), lambda p: F.struct(*[p[x].alias(x) for x in own], points(p["row"]).alias("overlap")))
    cohort = F.filter("cohort", lambda p: passes(p["row"]) & p["row"]["on_surface"])
    staged = pin(by_key(facts, "session_id").select("*", listed.alias("_pool"), size.alias("_n")), _near=near, _own=cohort).drop("_pool")
    shown = lambda p: p["row"]["on_surface"]
    pooled = lambda p: shown(p) & p["position"].isNotNull()
    offered = lambda p: p["offer"]["campaign_id"].isNull() | F.coalesce(F.array_contains("segments", p["offer"]["segment_id"]), F.lit(False))
    seed = lambda p: F.abs(string_hash32(F.concat(F.lit(salt), F.col("session_id").cast("string"), F.lit(":"), p["item_id"].cast("string"))))
    # places in _near, by the key and then the place in the pool
    by = lambda cond, key: F.transform(F.array_sort(F.filter(F.transform("_near", lambda p, i: F.when(cond(p), F.struct(key(p).alias("by"), p["position"].alias("at"), p["item_id"].alias("item_id"), (i + 1).alias("i")))), lambda x: x.isNotNull())), lambda s: s["i"])
    lists = {
        "preference_match": by(lambda p: pooled(p) & (p["overlap"] > 0), lambda p: -p["overlap"]),
        "persona_similar": F.transform("_own", lambda p, i: F.size("_near") + i + 1),
        "fresh_promoted": by(lambda p: p["promoted_rank"].isNotNull() & p["offer"].isNotNull() & offered(p), lambda p: p["promoted_rank"]),
        "fresh_catalog": by(lambda p: shown(p) & p["catalog_rank"].isNotNull(), lambda p: p["catalog_rank"]),
        "long_tail": by(lambda p: pooled(p) & (p["position"] > F.floor(F.col("_n") * R.LONG_TAIL_START)), lambda p: F.lit(0)),
        "serendipity": by(lambda p: pooled(p) & (p["overlap"] == 0), seed),
    }
    rows = F.concat(F.transform("_near", lambda p: p["row"]), F.transform("_own", lambda p: p["row"]))
    return pin(staged, queues=F.array(*[lists[q] for q in R.QUEUE_ORDER]), items=rows).drop("_near", "_own", "_n")


STRETCH = 16


# ---- acceptance ---------------------------------------------------------------------------------------------


def _moves(targets: Column, lists: Column, cap: int, head: int, quotas: bool) -> Column:
    """What acceptance tries, in order, as numbers: list * 4 + 2 for its whole rest + 1 where the quota counts. Lists 6
    to 11 hold the studio cut-outs of queues 0 to 5. A round leaves out queues that have met their quota or their end."""
    backfill = [R.QUEUE_ORDER.index(q) for q in R.BACKFILL_ORDER] if quotas else list(range(6))
    rest = lambda q: [q * 4 + 2, *[q * 4] * head, q * 4 + 2]
    tail = F.array(*[F.lit(m) for q in [*backfill, *(q + 6 for q in backfill)] for m in rest(q)])
    if not quotas:
        return tail
    open_in = lambda q, r: (F.element_at(targets, q + 1) > r) & (F.size(F.element_at(lists, q + 1)) > r)
    every = F.array(*[F.lit(q) for q in range(6)])
    rounds = F.transform(F.sequence(F.lit(0), F.array_max(targets)), lambda r: F.transform(F.filter(every, lambda q: open_in(q, r)), lambda q: q * 4 + 1))
    return F.concat(F.flatten(rounds), tail)


def _targets(cap: int) -> Column:
    out = None
    for preferred in (True, False):
        for cohort in (True, False):
            quota = R.queue_quota(cap, preferred, cohort)
            case = ((F.size("preferred") > 0) == preferred) & ((F.size("cohort") > 0) == cohort)
            row = F.array(*[F.lit(quota[q]) for q in R.QUEUE_ORDER])
            out = F.when(case, row) if out is None else out.when(case, row)
    return out


def acceptance(items: Column, lists: Column, names: Column, targets: Column, moves: Column, o: DeckOptions) -> Column:
    """Rows accepted from twelve lists of places in `items`, in order, as (queue, row).

    One cursor a list; a row that is passed over is not offered again by its list. A url comes once; among the first
    `head` rows a family or model comes once, and the first few rows of an onboarded session keep their distance. In
    that part rows are tested one by one; afterwards the next row is the first of the list's rest that was not taken.
    """
    at = lambda x, q: F.element_at(x, q + 1)
    put = lambda x, q, v: F.transform(x, lambda old, i: F.when(i == q, v).otherwise(old))

    def step(s, move):
        q, whole, quota = F.floor(move / 4).cast("int"), move.bitwiseAND(2) > 0, move.bitwiseAND(1) > 0
        n, cursor = F.size(s["out"]), at(s["cursors"], q)
        size = F.size(at(names, q))
        idle = (n >= o.cap) | (cursor >= size) | (whole & (n < o.head)) | (quota & (at(s["used"], q % 6) >= at(targets, q % 6)))

        def strict(r):
            new = ~F.array_contains(s["taken"], r["unique_key"])
            for key, seen in (("family_key", "families"), ("model_key", "models")):
                new = new & ~F.coalesce(F.array_contains(s[seen], r[key]), F.lit(False))
            near = F.coalesce(S.closest(r["tokens"], s["out"]["row"]) < o.first_distance, F.lit(False))
            return new & ~(F.coalesce(F.col("onboarded"), F.lit(False)) & (n < o.first) & near)

        def found(rest):
            """Places of the next row: of the first one that passes every test, or of the first one not taken yet."""
            new = lambda: F.transform(F.slice(F.array_except(rest, s["taken"]), 1, 1), lambda k: cursor + F.array_position(rest, k).cast("int"))
            tested = F.filter(F.sequence(cursor + 1, cursor + F.size(rest)), lambda i: strict(F.element_at(items, F.element_at(at(lists, q), i))))
            return F.when(n < o.head, F.slice(tested, 1, 1)).otherwise(new())

        def all_new(rest):
            keys = F.slice(F.array_except(rest, s["taken"]), F.lit(1), F.greatest(F.lit(0), o.cap - n))
            return F.transform(keys, lambda k: cursor + F.array_position(rest, k).cast("int"))

        def next_rows():
            """Mostly the next row is near, so a short stretch is looked at before the whole rest."""
            rest = lambda k: F.slice(at(names, q), cursor + 1, k)
            one = let(let(rest(F.lit(STRETCH)), found), lambda near: F.when((F.size(near) > 0) | (cursor + STRETCH >= size), near).otherwise(let(rest(size), found)))
            return F.when(whole, let(rest(size), all_new)).otherwise(one)

        def moved(places):
            rows = F.transform(places, lambda i: F.struct((q % 6).alias("queue"), F.element_at(items, F.element_at(at(lists, q), i)).alias("row")))
            return let(rows, lambda more: F.struct(
                F.concat(s["out"], more).alias("out"), F.concat(s["taken"], more["row"]["unique_key"]).alias("taken"),
                F.when(n < o.head, F.concat(s["families"], more["row"]["family_key"])).otherwise(s["families"]).alias("families"),
                F.when(n < o.head, F.concat(s["models"], more["row"]["model_key"])).otherwise(s["models"]).alias("models"),
                put(s["cursors"], q, F.when((F.size(places) == 0) | whole, size).otherwise(F.try_element_at(places, F.lit(1)))).alias("cursors"),
                put(s["used"], q % 6, at(s["used"], q % 6) + F.size(places)).alias("used")))

        return F.when(idle, s).otherwise(let(next_rows(), moved))

    nothing = F.transform(F.slice(items, 1, 0), lambda r: F.struct(F.lit(0).alias("queue"), r.alias("row")))
    none = F.array().cast("array<string>")
    state = F.struct(nothing.alias("out"), none.alias("taken"), none.alias("families"), none.alias("models"), F.array_repeat(F.lit(0), 12).alias("cursors"), F.array_repeat(F.lit(0), 6).alias("used"))
    return F.aggregate(moves, state, step, lambda s: s["out"])


def accepted(queued: DataFrame, o: DeckOptions) -> DataFrame:
    """Adds `out` (rows in the order of acceptance) and `fallback`. A session that has seen all it may be shown gets it
    again; studio cut-outs wait until the other rows of all queues were tried."""
    it = lambda i: F.element_at(F.col("items"), i)
    staged = pin(queued, _fresh=F.transform("queues", lambda q: F.filter(q, lambda i: ~F.array_contains("seen", it(i)["item_id"]))))
    staged = pin(staged, _again=F.forall("_fresh", lambda q: F.size(q) == 0))
    behind = lambda i: it(i)["cutout"] & F.lit(o.contextual_first)
    scene = F.concat(F.transform("_fresh", lambda q: F.filter(q, lambda i: ~behind(i))), F.transform("_fresh", lambda q: F.filter(q, behind)))
    again = F.concat("queues", F.transform("queues", lambda q: F.slice(q, 1, 0)))
    staged = pin(staged, _lists=F.when(F.col("_again"), again).otherwise(scene), _targets=_targets(o.cap)).drop("_fresh", "queues")
    moves = lambda quotas: _moves(F.col("_targets"), F.col("_lists"), o.cap, o.head, quotas)
    staged = pin(staged, _names=F.transform("_lists", lambda q: F.transform(q, lambda i: it(i)["unique_key"])), _moves=F.when(F.col("_again"), moves(False)).otherwise(moves(True)))
    staged = pin(staged, out=acceptance(F.col("items"), F.col("_lists"), F.col("_names"), F.col("_targets"), F.col("_moves"), o))
    fallback = F.when(F.size("out") == 0, "catalog_exhausted").when(F.col("_again"), "recycled_seen_items").otherwise("none")
    return staged.withColumn("fallback", fallback).drop("_again", "_lists", "_targets", "_moves", "_names", "items")


# ---- ranking and shaping ------------------------------------------------------------------------------------


def ranked(taken: DataFrame, o: DeckOptions) -> DataFrame:
    """Adds `rows`: accepted rows by score, ties by id. Sessions with a cohort blend its scores into their own."""
    w = F.col("weights")
    hits = lambda r: F.filter(F.transform(r["keys"], lambda k: w[k]), lambda x: x.isNotNull())
    total = lambda h: F.aggregate(h, F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x).cast("decimal(18,2)"))
    cohort = F.map_from_entries(F.transform("cohort", lambda p: F.struct(p["item_id"], p["normalized_score"])))
    staged = pin(taken, _cohort=cohort)
    scored = F.transform("out", lambda x: let(F.coalesce(hits(x["row"]), F.array().cast("array<decimal(12,2)>")), lambda h: F.struct(
        x["row"].alias("row"), x["queue"].alias("queue"), F.size(h).alias("signals"), F.coalesce(F.col("_cohort")[x["row"]["item_id"]], F.lit(0.0)).alias("cohort"),
        F.when(F.size(h) > 0, total(h).cast("double") / F.sqrt(F.size(h).cast("double"))).otherwise(0.0).alias("own"))))
    staged = pin(staged, _scored=scored)
    staged = pin(staged, _top=F.array_max(F.col("_scored")["cohort"]), _base=F.when(F.size(F.coalesce(F.map_keys("weights"), F.array())) > 0, o.alpha).otherwise(0.0))

    def score(x):
        a = F.when(x["signals"] == 0, F.least("_base", F.lit(o.cold_alpha))).otherwise(F.col("_base"))
        return F.when(F.col("_top") > 0, js_round(a * x["own"] + (1.0 - a) * (x["cohort"] / F.col("_top")), 6)).otherwise(x["own"])

    item = ("family_key", "model_key", "variant_key", "source_key", "quality_ok", "tokens", "retailer")
    order = F.array_sort(F.transform("_scored", lambda x: let(score(x), lambda v: F.struct((-v).alias("by"), x["row"]["item_id"].alias("item_id"), F.struct(
        x["row"]["item_id"].alias("item_id"), v.alias("score"), *[x["row"][c].alias(c) for c in item],
        (x["queue"] == R.QUEUE_ORDER.index("fresh_promoted")).alias("featured"), x["queue"].alias("queue")).alias("row")))))
    return pin(staged, rows=F.transform(order, lambda s: s["row"])).drop("out", "_cohort", "_scored", "_top", "_base")


def slate_facts(rows: Column) -> Column:
    """Repeat rate of families, largest share and number of sources among the first eight rows; least distance in style
    among the first four."""
    def measure(top):
        families = F.filter(top["family_key"], lambda x: x.isNotNull())
        sources = F.transform(top, lambda r: F.coalesce(r["source_key"], F.lit("unknown")))
        four = F.filter(F.slice(top, 1, 4), lambda r: F.size(r["tokens"]) >= 2)
        pairs = F.flatten(F.transform(four, lambda a, i: F.transform(F.slice(four, i + 2, F.size(four)), lambda b: 1.0 - S.overlap(a["tokens"], b["tokens"]))))
        repeats = F.size(families) - F.size(F.array_distinct(families))
        return F.struct(F.when(F.size(families) > 0, js_round(repeats / F.size(families), 4)).otherwise(0.0).alias("same_family_top8_rate"),
                        F.when(F.size(top) > 0, js_round(F.array_max(F.transform(sources, lambda s: F.size(F.filter(sources, lambda x: x == s)))) / F.size(top), 4)).otherwise(0.0).alias("source_concentration_top8"),
                        F.size(F.array_distinct(F.filter(top["source_key"], lambda x: x.isNotNull()))).cast("bigint").alias("source_diversity_top8"),
                        js_round(F.array_min(pairs), 4).alias("style_distance_top4_min"))

    return let(F.slice(rows, 1, 8), measure)


def build_slates(sessions: DataFrame, weights: DataFrame, items: DataFrame, offered: DataFrame, swipes: DataFrame, cohorts: DataFrame,
                 matches: DataFrame | Callable[[DataFrame], DataFrame], as_of: Column, every: Column | int | None = None, bounds=PRICE_BOUNDS, options: DeckOptions = DeckOptions(), keep=lambda df, name: df) -> DataFrame:
    """One row per session: rows (the deck), fallback, variant and the facts of the slate.

    sessions: (session_id, pick_hash, onboarded, want_size_class, want_color_family, want_seat_bucket, modular_only,
    want_small_space, budget_min, budget_max); weights with cold starts merged in; offered: see `offers`; cohorts:
    (pick_hash, item_id, normalized_score, rank); matches: (session_id, segment_id), or what gives them for the segments of
    a (segment_id) table: only segments that offers in the pool ask for are looked at. `every`: a featured place's gap.
    keep(df, name) may write a table that is read more than once and return the copy.
    """
    o = options
    shown = keep(deck_items(items, bounds), "deck_items")
    order = [F.desc("updated_day"), F.desc("item_id")]
    listed = shown.join(offered, "item_id", "left")
    pool = keep(R.recent_pool(listed.where(F.col("offer").isNotNull()), listed, o.pool, order, carry=("row", "offer")), "deck_pool")
    asked = pool.select("offer.segment_id").where(F.col("segment_id").isNotNull()).distinct()
    matches = matches(asked) if callable(matches) else matches.join(asked, "segment_id", "left_semi")
    facts = session_facts(sessions, weights, swipes, matches, cohorts, shown, as_of, o)
    facts = facts.withColumn("rate", R.adaptive_rate(o.exploration, F.col("confidence")) if o.exploration > 0 else F.lit(0.0))
    facts = facts.withColumn("_every", F.lit(o.shape.featured_every) if every is None else every if isinstance(every, Column) else F.lit(every))
    slates = ranked(accepted(queue_lists(facts, pool), o), o)
    slates = pin(slates, rows=S.mmr(F.col("rows"), o.mmr_lambda, o.mmr_top, 2 * o.limit))
    slates = pin(slates, rows=S.explore(F.col("rows"), F.col("session_id"), F.col("rate"), o.limit, o.seed))
    slates = pin(slates, rows=S.shape_slate(F.col("rows"), o.shape, F.col("_every")))
    variant = R.variant_label(F.size("cohort") > 0, F.col("rate"))
    return slates.select("session_id", "rows", "fallback", variant.alias("variant"), slate_facts(F.col("rows")).alias("facts"))


def deck_rows(slates: DataFrame) -> DataFrame:
    """(session_id, position, item_id, score, queue, featured) of `build_slates`."""
    names = F.array(*[F.lit(q) for q in R.QUEUE_ORDER])
    return S.unpack(slates, "queue", "featured").withColumn("queue", F.element_at(names, F.col("queue") + 1))
