"""Deck filters and gates over candidate items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import contains_any, norm_token, norm_tokens

# Facets compared as stated, and facets where the item column wins over its classification.
STATED_FACETS = ("size_class", "color_family", "new_used", "sub_category")
TAXONOMY_FACETS = ("primary_category", "sofa_shape", "sofa_function", "seat_bucket")


def facet(df: DataFrame, name: str) -> Column:
    """Item column, else the classification's value, as a token."""
    cols = [F.col(c) for c in (name, f"classified_{name}") if c in df.columns]
    return norm_token(F.coalesce(*cols)) if cols else F.lit(None).cast("string")


def environment_ok(c: Column, env: str) -> Column:
    """'both' items match indoor and outdoor; unknown never matches."""
    allowed = {"indoor": ("indoor", "both"), "outdoor": ("outdoor", "both"), "both": ("both",)}[env]
    return F.coalesce(c.isin(*allowed), F.lit(False))


def facet_filter(df: DataFrame, room_type: str | None = None, environment: str | None = None, **facets: str) -> DataFrame:
    """Conjunction of the given facet values; unset facets are not tested."""
    cond = F.lit(True)
    for name, value in facets.items():
        if name not in STATED_FACETS + TAXONOMY_FACETS:
            raise ValueError(f"unknown facet {name}")
        if value is not None:
            left = F.col(name) if name in STATED_FACETS else facet(df, name)
            cond = cond & (left == value)
    if environment:
        cond = cond & environment_ok(facet(df, "environment"), environment)
    if room_type:
        cond = cond & F.array_contains("room_types", room_type)
    return df.where(cond)


def price_filter(df: DataFrame, lo: float | None, hi: float | None) -> DataFrame:
    """Prices inside the range; items without a price pass."""
    p = F.col("price_amount")
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (p >= lo)
    if hi is not None:
        cond = cond & (p <= hi)
    return df.where(p.isNull() | cond)


def included(flag: Column) -> Column:
    return ~flag.eqNullSafe(F.lit(False))


# Title words of the sofa surface and of accessories, and its categories.
SURFACE_TITLE = [
    "soffa", "soffor", "sofa", "sofás", "sofá", "couch", "divansoffa", "hörnsoffa", "modulsoffa", "bäddsoffa",
    "2-sits", "3-sits", "4-sits", "chaise",
]
SURFACE_NOISE = [
    "dynset", "sittdyna", "ryggdyna", "soffdyna", "dyna soffa", "soffbord", "soffkudde", "sofftäcke", "sofföverdrag",
    "överdrag", "klädsel", "cover for", "slipcover", "sofa table", "sofa cushion", "sofa cover", "cover",
    "förvaringsbänk", "forvaringsbank", "bänk", "bank", "bench", "funda"]
SURFACE_CATEGORIES = ("sofa", "corner_sofa", "bed_sofa")


def surface_gate(title: Column, decision: Column, category: Column, positive=None, noise=None, categories=None) -> Column:
    """Noise titles and REJECT fail; ACCEPT passes; else the category, else the title heuristic."""
    positive, noise, categories = positive or SURFACE_TITLE, noise or SURFACE_NOISE, categories or SURFACE_CATEGORIES
    t = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(contains_any(t, noise) | F.coalesce(decision == "REJECT", F.lit(False)), False)
        .when(F.coalesce(decision == "ACCEPT", F.lit(False)), True)
        .when(F.coalesce(category.isin(*categories), F.lit(False)), True)
        .otherwise(contains_any(t, positive)))


# Issues that keep an item from being displayed.
CRITICAL_ISSUES = ("no-images", "no-valid-images", "broken", "validation-error", "fetch-failed",
                   "non-image-response", "domain-blocked")


def image_gate(image_count: Column, issues: Column, validated: Column, valid_count: Column) -> Column:
    critical = F.arrays_overlap(norm_tokens(issues), F.array(*[F.lit(i) for i in CRITICAL_ISSUES]))
    none_valid = F.coalesce(validated, F.lit(False)) & F.coalesce(valid_count <= 0, F.lit(False))
    return (F.coalesce(image_count, F.lit(0)) > 0) & ~critical & ~none_valid


MEDIUM_SWIPES, HARD_SWIPES = 4, 10
# Onboarding budget bands and the sub-categories of each seat bucket.
BUDGET_BANDS = {"lt_5k": (None, 5000.0), "5k_15k": (5000.0, 15000.0), "15k_30k": (15000.0, 30000.0), "30k_plus": (30000.0, None)}
SEAT_SUBCATEGORIES = {"2": ("2_seater",), "3": ("3_seater",), "4_plus": ("4_seater", "corner_sofa", "u_sofa")}


def onboarding_stage(swipes: Column) -> Column:
    return F.when(swipes >= HARD_SWIPES, "hard").when(swipes >= MEDIUM_SWIPES, "medium").otherwise("soft")


def onboarding_filter(candidates: DataFrame, profiles: DataFrame, swipes: DataFrame) -> DataFrame:
    """Session candidates after its staged constraints.

    soft keeps all; medium applies seats, modular and small space; hard adds
    the budget range. Profiles and counts are one row per session, so the
    candidate rows are shuffled once, on the session.
    """
    counts = swipes.groupBy("session_id").agg(F.count("*").alias("n_swipes"))
    rows = candidates.join(profiles, "session_id", "left").join(counts, "session_id", "left")
    stage = onboarding_stage(F.coalesce("n_swipes", F.lit(0)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    subs = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v) for v in x])
                          for kv in SEAT_SUBCATEGORIES.items() for x in kv])
    want, bucket = F.col("want_seat_bucket"), facet(rows, "seat_bucket")
    by_sub = F.array_contains(subs[want], facet(rows, "sub_category"))
    seats = want.isNull() | F.when(bucket.isNotNull(), bucket == want).otherwise(yes(by_sub))
    modular = ~yes(F.col("modular_only")) | yes(F.col("modular"))
    small = ~yes(F.col("want_small_space")) | yes(F.col("small_space"))
    p = F.col("price_amount")
    budget = p.isNull() | ((p >= F.coalesce("budget_min", F.lit(0.0))) & (p <= F.coalesce("budget_max", p)))
    return rows.withColumn("stage", stage).where(
        (F.col("stage") == "soft") | (seats & modular & small & ((F.col("stage") != "hard") | budget)))


def description_matches(title: Column, description: Column, head: int | None = None) -> Column:
    """Some title word of more than three letters occurs in the description; untestable rows pass.

    `head` limits the test to the first characters; None reads the whole text.
    """
    words = F.filter(F.split(F.lower(title), r"[\s,\-/]+"), lambda w: (F.length(w) > 3) & F.rlike(w, F.lit(r"^\p{L}+$")))
    text = F.lower(F.substring(description, 1, head) if head else description)
    untestable = (F.coalesce(title, F.lit("")) == "") | (F.coalesce(description, F.lit("")) == "") | (F.size(words) == 0)
    return untestable | F.exists(words, lambda w: F.contains(text, w))
