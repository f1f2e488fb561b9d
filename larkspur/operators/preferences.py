"""Preference learning: item features, session weights, personas and onboarding priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.numbers import js_round
from larkspur.functions.price import PRICE_BOUNDS, price_bucket
from larkspur.functions.staging import by_key, pin
from larkspur.functions.text import norm_token, norm_tokens

WEIGHT = "decimal(12,2)"

# Feature families as (key prefix, item column); style tags carry no prefix.
ARRAY_FAMILIES = [("", "style_tags"), ("eco:", "eco_tags"), ("room:", "room_types")]
TOKEN_FAMILIES = [
    ("material:", "material"), ("color:", "color_family"), ("size:", "size_class"), ("brand:", "brand"),
    ("delivery:", "delivery_complexity"), ("condition:", "new_used"), ("primary:", "primary_category"),
    ("sofa_shape:", "sofa_shape"), ("sofa_function:", "sofa_function"), ("seat_bucket:", "seat_bucket"),
    ("environment:", "environment"), ("subcat:", "sub_category"), ("cover:", "cover_material"),
    ("frame:", "frame_material"), ("legs:", "leg_material"), ("filling:", "cushion_filling")]
FLAG_FAMILIES = [("feature:small_space", "small_space"), ("feature:modular", "modular")]


def prefixed(tokens: Column, prefix: str) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(prefix), t)) if prefix else tokens


def feature_keys(items: DataFrame, bounds=PRICE_BOUNDS, families: set[str] | None = None) -> Column:
    """Array of the item's preference keys; only families whose column exists (and is listed) count."""
    have = lambda prefix, c: c in items.columns and (families is None or prefix in families)
    arrays = [prefixed(norm_tokens(F.col(c)), p) for p, c in ARRAY_FAMILIES if have(p, c)]
    singles = []
    for p, c in TOKEN_FAMILIES:
        if have(p, c):
            token = norm_token(F.col(c).cast("string"))
            singles.append(F.concat(F.lit(p), F.when(token != "unknown", token) if c == "environment" else token))
    singles += [F.when(F.col(c), key) for key, c in FLAG_FAMILIES if have(key, c)]
    if have("price_bucket:", "price_amount"):
        singles.append(F.concat(F.lit("price_bucket:"), price_bucket(F.col("price_amount"), bounds)))
    if have("seats:", "seat_count"):
        singles.append(F.when((F.col("seat_count") > 0) & (F.col("seat_count") <= 20),
                              F.concat(F.lit("seats:"), F.col("seat_count").cast("string"))))
    return F.concat(*arrays, F.array_compact(F.array(*singles)))


def item_features(items: DataFrame, bounds=PRICE_BOUNDS) -> DataFrame:
    return items.select("item_id", F.explode(feature_keys(items, bounds)).alias("key"))


RIGHT_DELTA, LEFT_DELTA = "1.00", "-0.35"


def swipe_deltas(swipes: DataFrame) -> Column:
    return F.when(F.col("direction") == "right", F.lit(RIGHT_DELTA).cast(WEIGHT)).otherwise(F.lit(LEFT_DELTA).cast(WEIGHT))


def learn_weights(swipes: DataFrame, items: DataFrame, bounds=PRICE_BOUNDS) -> DataFrame:
    """(session_id, key, weight): swipe deltas summed over the features of the swiped items.

    Swipes collapse to one row per (session, item) before the item join, so a
    popular item joins once per session; sums are exact decimals, independent
    of task order.
    """
    net = swipes.groupBy("session_id", "item_id").agg(F.sum(swipe_deltas(swipes)).cast(WEIGHT).alias("delta"))
    keyed = items.select("item_id", feature_keys(items, bounds).alias("keys"))
    exploded = net.join(keyed, "item_id").select("session_id", F.explode("keys").alias("key"), "delta")
    return exploded.groupBy("session_id", "key").agg(F.sum("delta").cast(WEIGHT).alias("weight"))


def top_keys(weights: DataFrame, k: int = 14) -> DataFrame:
    """Best k positive keys per session; a session holds at most one row per key."""
    w = Window.partitionBy("session_id").orderBy(F.desc("weight"), "key")
    return weights.where(F.col("weight") > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def preference_confidence(weights: DataFrame) -> DataFrame:
    """Largest positive weight over the sum of positive weights."""
    pos = F.when(F.col("weight") > 0, F.col("weight"))
    return weights.groupBy("session_id").agg(F.coalesce(
        F.max(pos).cast("double") / F.sum(pos).cast("double"), F.lit(0.0)).alias("confidence"))


# ---- personas ----------------------------------------------------------------------------------

HALF_LIFE_DAYS, DECAY_FLOOR, MIN_COHORT = 45.0, 0.25, 2
SIGNAL_WEIGHTS = {"like": 1.0, "swipe_right": 0.35, "outbound_click": 0.55}


def decay(ts: Column, now: Column, half_life: float = HALF_LIFE_DAYS, floor: float = DECAY_FLOOR) -> Column:
    """Exponential recency factor between floor and 1; a missing time counts as now."""
    age = F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", ts, now) / 86400e6)
    return F.coalesce(F.greatest(F.lit(floor), F.least(F.lit(1.0), F.exp(age * (-0.6931471805599453 / half_life)))), F.lit(1.0))


def persona_signals(picks: DataFrame, likes: DataFrame, swipes: DataFrame, clicks: DataFrame, now: Column,
                    top: int = 50) -> DataFrame:
    """Per cohort: best items by decayed signals over cohort size.

    picks: (session_id, pick_hash). Repeated right swipes and clicks of a
    session on an item count once. Signals are first summed per (cohort, item,
    session), which gives the supporting sessions without a distinct
    aggregate and shrinks hot items before the second sum.
    """
    first = lambda df: df.groupBy("session_id", "item_id").agg(F.min("ts").alias("ts"))
    tag = lambda df, s: df.select("session_id", "item_id", "ts", F.lit(s).alias("signal"))
    signals = tag(likes, "like").unionByName(tag(first(swipes.where(F.col("direction") == "right")), "swipe_right")).unionByName(
        tag(first(clicks), "outbound_click"))
    weight = F.lit(0.0)
    for name, value in SIGNAL_WEIGHTS.items():
        weight = F.when(F.col("signal") == name, value).otherwise(weight)
    sizes = picks.groupBy("pick_hash").agg(F.count("*").alias("user_count")).where(F.col("user_count") >= MIN_COHORT)
    members = picks.join(sizes, "pick_hash")
    per_session = signals.join(members, "session_id").groupBy("pick_hash", "item_id", "session_id").agg(
        F.sum(weight * decay(F.col("ts"), now)).alias("s"), F.first("user_count").alias("user_count"),
        *[F.count_if(F.col("signal") == n).alias(n) for n in SIGNAL_WEIGHTS])
    scored = per_session.groupBy("pick_hash", "item_id").agg(
        F.sum("s").alias("raw"), F.first("user_count").alias("user_count"), F.count("*").alias("supporting_sessions"),
        *[F.sum(n).alias(f"{n}_count") for n in SIGNAL_WEIGHTS])
    w = Window.partitionBy("pick_hash").orderBy(F.desc("raw_score"), "item_id")
    return (scored.withColumns({"raw_score": js_round(F.col("raw"), 4),
                                "normalized_score": js_round(F.col("raw") / F.col("user_count"), 4)})
            .drop("raw").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))


def persona_maps(signals: DataFrame) -> DataFrame:
    """One row per cohort with its item scores as a map (at most `top` entries)."""
    return signals.groupBy("pick_hash").agg(
        F.first("user_count").alias("user_count"),
        F.map_from_entries(F.collect_list(F.struct("item_id", "normalized_score"))).alias("item_scores"))


# ---- onboarding -----------------------------------------------------------------------------------

PICK_BOOST, SCENE_BOOST, VIBE_BOOST, MODULAR_BOOST, SMALL_BOOST = "3.00", "2.50", "2.75", "3.00", "2.90"

# Preference keys suggested by onboarding scenes and sofa vibes.
SCENE_SIGNALS = {
    "calm_minimal": ["minimal", "scandinavian", "modern", "color:white", "color:grey"],
    "warm_organic": ["scandinavian", "material:wood", "color:beige", "color:brown"],
    "bold_eclectic": ["vintage", "color:green", "color:blue"],
    "urban_industrial": ["industrial", "modern", "color:black", "material:metal"],
}
VIBE_SIGNALS = {
    "rounded_boucle": ["material:boucle", "material:fabric", "color:beige"],
    "low_profile_linen": ["material:linen", "size:medium", "feature:small_space"],
    "structured_leather": ["material:leather", "color:brown", "color:black"],
    "modular_cloud": ["feature:modular", "subcat:modular_sofa"],
}
# Catalog spellings of keys that the maps above write differently.
CATALOG_ALIASES = {"color:grey": "color:gray", "material:linen": "material:fabric"}
# Explanation lines by scene, vibe and constraint, in display order.
EXPLANATIONS = [
    ("scenes", "warm_organic", "Warm neutrals"), ("scenes", "calm_minimal", "Calm minimal lines"),
    ("scenes", "bold_eclectic", "Expressive contrast"), ("scenes", "urban_industrial", "Structured forms"),
    ("vibes", "rounded_boucle", "Rounded soft forms"), ("vibes", "low_profile_linen", "Low relaxed profile"),
    ("vibes", "structured_leather", "Tailored silhouettes"), ("vibes", "modular_cloud", "Modular flexibility"),
    ("small_space", None, "Small-space prioritization"), ("modular_only", None, "Modular-only preference"),
    ("kids_pets", None, "Family-friendly durability")]


def pick_attributes(picks: DataFrame, items: DataFrame, n: int = 3) -> DataFrame:
    """Distinct tags, materials and colours of the first n picks, with the hash of all picks.

    picks: (session_id, picked array). Each session explodes to at most n rows.
    """
    head = picks.select("session_id", F.explode(F.slice("picked", 1, n)).alias("item_id"))
    traits = head.join(items.select("item_id", "style_tags", "material", "color_family"), "item_id")
    sets = traits.groupBy("session_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("style_tags")))).alias("style_tags"),
        F.array_sort(F.collect_set("material")).alias("materials"),
        F.array_sort(F.collect_set("color_family")).alias("color_families"))
    hashed = picks.select("session_id", F.array_join(F.array_sort(F.transform("picked", lambda x: x.cast("string"))), "-").alias("pick_hash"))
    empty = F.array().cast("array<string>")
    return hashed.join(sets, "session_id", "left").select(
        "session_id", "pick_hash", *[F.coalesce(c, empty).alias(c) for c in ("style_tags", "materials", "color_families")])


def derived_profile(profiles: DataFrame) -> DataFrame:
    """Primary and secondary style, confidence, at most four explanation lines and the pick hash."""
    scenes, vibes = norm_tokens(F.col("scenes")), norm_tokens(F.col("vibes"))
    both = F.concat(scenes, vibes)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    constraints = (F.col("budget_band").isNotNull().cast("int") + F.col("seat_count").isNotNull().cast("int")
                   + sum((flag(c).cast("int") for c in ("modular_only", "kids_pets", "small_space")), F.lit(0)))
    confidence = F.least(F.lit(0.95), js_round(
        F.least(F.lit(0.45), F.size(scenes) * 0.225) + F.least(F.lit(0.35), F.size(vibes) * 0.175)
        + F.least(F.lit(0.2), constraints * 0.04), 2))
    lines = F.array_compact(F.array(*[
        F.when(F.array_contains(scenes if col == "scenes" else vibes, value) if value else flag(col), text)
        for col, value, text in EXPLANATIONS]))
    return profiles.select(
        "session_id", F.try_element_at(both, F.lit(1)).alias("primary_style"),
        F.try_element_at(both, F.lit(2)).alias("secondary_style"), confidence.alias("confidence"),
        F.slice(lines, 1, 4).alias("explanation"), F.array_join(F.array_sort(both), "-").alias("pick_hash"))


def _signal_map(table: dict[str, list[str]], aliases: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(aliases.get(v, v)) for v in x])
                          for kv in table.items() for x in kv])


def onboarding_weights(profiles: DataFrame, use_aliases: bool = False) -> DataFrame:
    """Prior weights of scenes, vibes and constraints; the maximum per (session, key).

    The sessions are dealt over the full shuffle width before their keys are
    listed, so that no task of a small file aggregates the keys of millions.
    """
    aliases = CATALOG_ALIASES if use_aliases else {}
    scene_map, vibe_map = _signal_map(SCENE_SIGNALS, aliases), _signal_map(VIBE_SIGNALS, aliases)
    entry = lambda key, w: F.struct(key.alias("key"), F.lit(w).cast(WEIGHT).alias("weight"))
    expand = lambda col, table, w: F.flatten(F.transform(norm_tokens(F.col(col)), lambda t: F.transform(
        F.coalesce(table[t], F.array().cast("array<string>")), lambda k: entry(k, w))))
    flags = F.array_compact(F.array(
        F.when(F.col("modular_only"), entry(F.lit("feature:modular"), MODULAR_BOOST)),
        F.when(F.col("small_space"), entry(F.lit("feature:small_space"), SMALL_BOOST)),
        F.when(F.col("kids_pets"), entry(F.lit("material:fabric"), SCENE_BOOST))))
    rows = by_key(profiles, "session_id").select("session_id", F.inline(F.concat(
        expand("scenes", scene_map, SCENE_BOOST), expand("vibes", vibe_map, VIBE_BOOST), flags)))
    return rows.groupBy("session_id", "key").agg(F.max("weight").alias("weight"))


def pick_weights(attributes: DataFrame) -> DataFrame:
    """Cold-start weights of the picked attributes."""
    keys = F.array_distinct(F.concat(
        F.col("style_tags"), prefixed(F.col("materials"), "material:"), prefixed(F.col("color_families"), "color:")))
    return attributes.select("session_id", F.explode(keys).alias("key"), F.lit(PICK_BOOST).cast(WEIGHT).alias("weight"))


def merge_weights(learned: DataFrame, picks: DataFrame, priors: DataFrame, swipe_counts: DataFrame,
                  limited: int = 5) -> DataFrame:
    """Learned weights; sessions with fewer than `limited` swipes add picks, then priors, for keys not set before."""
    cold = lambda df: df.join(swipe_counts.where(F.col("n_swipes") >= limited), "session_id", "left_anti")
    ranked = [df.select("session_id", "key", F.col("weight").cast(WEIGHT).alias("weight"), F.lit(i).alias("rank"))
              for i, df in enumerate((learned, cold(picks), cold(priors)))]
    union = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    return union.groupBy("session_id", "key").agg(F.min_by("weight", "rank").alias("weight"))


def item_profiles(items: DataFrame, bounds=PRICE_BOUNDS, families: set[str] | None = None) -> DataFrame:
    """Items with the id of their feature profile: items with equal keys score alike in every session."""
    keyed = pin(items, keys=F.array_sort(feature_keys(items, bounds, families)))
    return keyed.withColumn("profile_id", F.sha2(F.array_join("keys", "\u0001"), 256))
