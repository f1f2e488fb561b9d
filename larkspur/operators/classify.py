"""Item classification: lexicon evidence, category scores, taxonomy profile, surface policies.

Everything here is row-wise over arrays held in the item row, so a whole
catalog is classified in one scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.numbers import js_round
from larkspur.functions.staging import pin
from larkspur.functions.text import contains_any, first_match


@dataclass(frozen=True)
class Category:
    name: str
    positive: list[str]
    negative: list[str] = field(default_factory=list)


# Positive and negative title words per category, in priority order.
CATEGORIES = [
    Category("sofa", [
        "soffa", "soffor", "sofa", "sofas", "couch", "divansoffa", "hörnsoffa", "modulsoffa", "u-soffa", "l-soffa",
        "bäddsoffa", "bäddsoffor", "sleeper sofa", "sofa bed", "sov-soffa", "3-sits", "2-sits", "4-sits", "3-seater",
        "2-seater", "4-seater",
    ], [
        "soffbord", "soffkudde", "sofftäcke", "sofa table", "sofa cushion", "dynset", "sittdyna", "ryggdyna",
        "dyna soffa", "soffdyna", "sofföverdrag", "överdrag soffa", "sofa cover", "klädsel",
    ]),
    Category("armchair", [
        "fåtölj", "fåtöljer", "armchair", "armchairs", "karmstol", "öronlappsfåtölj", "snurrstol",
    ]),
    Category("dining_table", ["matbord", "dining table", "köksbord"], [
        "matbordslampa", "matbordsstol",
    ]),
    Category("coffee_table", ["soffbord", "coffee table", "vardagsrumsbord"]),
    Category("bed", ["säng", "sängar", "bed", "beds", "ramsäng", "kontinentalsäng"], [
        "bäddset", "sängkläder", "sängbord", "bedside", "bed frame",
    ]),
    Category("chair", ["stol", "stolar", "chair", "chairs", "matstol", "pinnstol", "barstol"], ["stolsdyna"]),
    Category("rug", ["matta", "mattor", "rug", "rugs", "carpet"]),
    Category("lamp", ["lampa", "lampor", "lamp", "light", "lighting", "taklampa", "bordslampa", "golvlampa"]),
    Category("storage", [
        "förvaring", "byrå", "skänk", "sideboard", "bokhylla", "hyllsystem", "tv-bänk", "vitrinskåp",
    ]),
    Category("desk", ["skrivbord", "desk", "kontorsbord", "arbetsbord"]),
    Category("decor", ["inredning", "dekoration", "decor", "vas", "ljusstake", "spegel", "tavla", "konst"]),
    Category("textile", ["textil", "kudde", "pläd", "gardin", "curtain", "cushion", "throw"]),
]

# Weight of each evidence source.
SOURCE_WEIGHTS = {"breadcrumb": 3.0, "title": 2.0, "url_path": 1.5, "enrichment_product_type": 2.5, "facet": 1.0,
                  "description": 0.5}


def _lexicon(categories: list[Category]) -> Column:
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.array(*[
        F.struct(F.lit(c.name).alias("category"), strings(c.positive).alias("pos"), strings(c.negative).alias("neg"))
        for c in categories])


_EVIDENCE = "array<struct<source:string,weight:double,category:string,tokens:array<string>>>"


def _hits(text: Column, source: str, lexicon: Column, strict: bool, categories: list[Category]) -> Column:
    """Evidence of one text; strict sources drop a category with a negative word.

    A single pattern over every positive word screens the text first, so rows
    without any hit never walk the lexicon.
    """
    every = sorted({t for c in categories for t in c.positive})
    found = F.transform(lexicon, lambda e: F.struct(
        F.lit(source).alias("source"), F.lit(SOURCE_WEIGHTS[source]).alias("weight"), e["category"].alias("category"),
        F.filter(e["pos"], lambda t: F.contains(text, t) & (
            ~F.exists(e["neg"], lambda n: F.contains(text, n)) if strict else F.lit(True))).alias("tokens")))
    return F.when(contains_any(text, every), F.filter(found, lambda x: F.size(x["tokens"]) > 0)).otherwise(
        F.array().cast(_EVIDENCE))


def build_evidence(items: DataFrame, categories: list[Category] | None = None,
                   description_chars: int | None = None) -> DataFrame:
    """Add `evidence`: (source, weight, category, tokens) for every source that hits.

    Reads the columns title, breadcrumb_text, url_path, product_type, facet_texts
    and description where present. description_chars=None reads whole texts.
    """
    categories = categories or CATEGORIES
    lex = _lexicon(categories)
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    parts = []
    for col, source, strict in (("breadcrumb_text", "breadcrumb", True), ("title", "title", True),
                                ("url_path", "url_path", False)):
        if col in items.columns:
            parts.append(_hits(text(col), source, lex, strict, categories))
    if "product_type" in items.columns:
        names = [c.name for c in categories]
        stated = F.lower(F.trim("product_type"))
        mapped = F.when(stated.isin(*names), stated).when(stated.isin("bed_sofa", "corner_sofa"), "sofa")
        parts.append(F.when(mapped.isNotNull(), F.array(F.struct(
            F.lit("enrichment_product_type").alias("source"), F.lit(2.5).alias("weight"), mapped.alias("category"),
            F.array(mapped).alias("tokens")))).otherwise(F.array().cast(_EVIDENCE)))
    if "facet_texts" in items.columns:
        parts.append(F.flatten(F.transform("facet_texts", lambda f: _hits(F.lower(f), "facet", lex, False, categories))))
    if "description" in items.columns:
        desc = text("description")
        parts.append(_hits(F.substring(desc, 1, description_chars) if description_chars else desc,
                           "description", lex, False, categories))
    return pin(items, evidence=F.concat(*[p.cast(_EVIDENCE) for p in parts]))


def score_categories(evidence: DataFrame, categories: list[Category] | None = None) -> DataFrame:
    """Add `scores`: (category, probability) by descending score, or unknown with 1.0.

    Every matched token is tested against all lexicons again, so a word may
    support several categories and count against others.
    """
    categories = categories or CATEGORIES
    lex = _lexicon(categories)

    def raw(e: Column) -> Column:
        def add(acc, ev):
            pos = F.size(F.filter(ev["tokens"], lambda t: (t == e["category"]) | F.array_contains(e["pos"], t)))
            neg = F.size(F.filter(ev["tokens"], lambda t: F.array_contains(e["neg"], t)))
            return acc + ev["weight"] * (pos - neg * 2)
        return F.aggregate("evidence", F.lit(0.0), add)

    scored = pin(evidence, _raw=F.filter(
        F.transform(lex, lambda e, i: F.struct((-raw(e)).alias("neg_score"), i.alias("i"), e["category"].alias("category"))),
        lambda s: s["neg_score"] < 0))
    scored = pin(scored, _total=F.aggregate("_raw", F.lit(0.0), lambda a, s: a - s["neg_score"]))
    ranked = F.transform(F.array_sort("_raw"), lambda s: F.struct(
        s["category"].alias("category"), js_round(-s["neg_score"] / F.col("_total"), 4).alias("probability")))
    unknown = F.array(F.struct(F.lit("unknown").alias("category"), F.lit(1.0).alias("probability")))
    return pin(scored, scores=F.when(F.size("_raw") > 0, ranked).otherwise(unknown)).drop("_raw", "_total")


def top_categories(scored: DataFrame) -> DataFrame:
    """Add primary_category, top1_confidence, top1_top2_margin and the top-5 probability map."""
    first = F.element_at("scores", 1)
    second = F.coalesce(F.try_element_at("scores", F.lit(2))["probability"], F.lit(0.0))
    return scored.withColumns({
        "primary_category": first["category"], "top1_confidence": first["probability"],
        "top1_top2_margin": first["probability"] - second,
        "category_probabilities": F.map_from_entries(F.slice("scores", 1, 5))})


# Sofa shape, function, seat, room and environment words; first match wins except for rooms.
SHAPES = {
    "u_shaped": ["u-soffa", "u formad soffa", "u-formad soffa", "u-shaped sofa", "u shaped sofa", "u shape sofa"],
    "corner": ["hörnsoffa", "hörnsoffor", "corner sofa", "l-soffa", "l formad", "l-formad", "esquina"],
    "chaise": [
        "divansoffa", "divan soffa", "chaise longue", "chaise lounge", "schäslong", "med schäslong", "chaselong",
        "c/chaise",
    ],
    "modular": ["modulsoffa", "modulsoffor", "modular sofa", "sektionssoffa", "byggsoffa", "sectional"],
}
FUNCTIONS = {
    "sleeper": [
        "bäddsoffa", "bäddsoffor", "sleeper sofa", "sofa bed", "sov-soffa", "sofá-cama", "sofá cama", "futon",
        "daybed", "dagbädd",
    ],
}
SEATS = {
    "2": ["2-sits", "2 sits", "2-sitssoffa", "2-seater", "2 seater", "tvåsits", "loveseat"],
    "3": ["3-sits", "3 sits", "3-sitssoffa", "3-seater", "3 seater", "tresits"],
    "4_plus": ["4-sits", "4 sits", "4-sitssoffa", "4-seater", "4 seater", "5-sits", "6-sits", "5-seater", "6-seater"],
}
SEAT_PATTERNS = [("4_plus", r"\b([4-9]|[1-9]\d)\s*[- ]?(sits|seater|seat)\b"), ("3", r"\b3\s*[- ]?(sits|seater|seat)\b"),
                 ("2", r"\b2\s*[- ]?(sits|seater|seat)\b")]
ROOMS = {
    "living_room": ["vardagsrum", "living room", "living-room", "lounge", "vardagsrumssoffa", "tv-rum"],
    "bedroom": ["sovrum", "bedroom", "sängkammare"],
    "outdoor": [
        "utomhus", "outdoor", "trädgård", "balkong", "altan", "utesoffa", "utemöbel", "garden", "patio", "terrace",
        "terrass",
    ],
    "office": ["kontor", "office", "arbetsrum", "hemmakontor", "home office"],
    "hallway": ["hall", "entré", "hallway", "entrance", "foajé"],
    "kids_room": ["barnrum", "kids room", "barnsoffa", "kids", "children"],
}
ENVIRONMENTS = {
    "outdoor": [
        "utomhus", "outdoor", "trädgård", "garden", "balkong", "patio", "terrace", "terrass", "altan", "utesoffa",
        "utemöbel", "utegrupp",
    ],
    "indoor": [
        "indoor", "inomhus", "vardagsrum", "living room", "lounge", "tv-rum", "sovrum", "bedroom", "kontor",
        "office", "hall", "hallway",
    ],
}


def derive_profile(items: DataFrame, sofa: str = "sofa") -> DataFrame:
    """Add shape, function, seat bucket, rooms, environment and legacy sub-category.

    Needs primary_category and profile_text (all text signals, lower case);
    seat_count and product_type are used where present.
    """
    text, is_sofa = F.col("profile_text"), F.col("primary_category") == sofa
    seats = F.col("seat_count") if "seat_count" in items.columns else F.lit(None).cast("bigint")
    stated = F.when(seats >= 4, "4_plus").when(seats == 3, "3").when(seats == 2, "2")
    by_text = first_match(text, SEATS)
    for bucket, pattern in SEAT_PATTERNS:
        by_text = F.coalesce(by_text, F.when(F.rlike(text, F.lit(pattern)), bucket))
    rooms = F.array_compact(F.array(*[F.when(contains_any(text, ts), room) for room, ts in ROOMS.items()]))
    base = items.withColumn("room_types", rooms)
    typed = F.lower(F.trim("product_type")) == "outdoor" if "product_type" in items.columns else F.lit(False)
    outdoor = (contains_any(text, ENVIRONMENTS["outdoor"]) | F.coalesce(typed, F.lit(False))
               | F.array_contains("room_types", "outdoor"))
    indoor = contains_any(text, ENVIRONMENTS["indoor"]) | (F.size(F.array_remove("room_types", "outdoor")) > 0)
    axes = base.withColumns({
        "sofa_shape": F.when(is_sofa, F.coalesce(first_match(text, SHAPES), F.lit("straight"))),
        "sofa_function": F.when(is_sofa, F.coalesce(first_match(text, FUNCTIONS), F.lit("standard"))),
        "seat_bucket": F.when(is_sofa, F.when(seats > 0, stated).otherwise(by_text)),
        "environment": F.when(outdoor & indoor, "both").when(outdoor, "outdoor").when(indoor | is_sofa, "indoor")
        .otherwise("unknown")})
    shape_names = F.create_map(*[F.lit(x) for kv in (
        ("u_shaped", "u_sofa"), ("corner", "corner_sofa"), ("chaise", "chaise_sofa"), ("modular", "modular_sofa")) for x in kv])
    seat_names = F.create_map(*[F.lit(x) for kv in (("4_plus", "4_seater"), ("3", "3_seater"), ("2", "2_seater")) for x in kv])
    return axes.withColumn("sub_category", F.when(is_sofa, F.coalesce(
        F.when(F.col("sofa_function") == "sleeper", "sleeper_sofa"), shape_names[F.col("sofa_shape")],
        seat_names[F.col("seat_bucket")])))


# ---- surface policies ----------------------------------------------------------------------


@dataclass(frozen=True)
class SurfacePolicy:
    surface: str
    allowed: tuple[str, ...]
    accept: float = 0.60
    reject: float = 0.20
    margin: float = 0.10
    completeness: float = 0.40
    require_images: bool = True
    require_price: bool = True
    min_price: float | None = None
    max_price: float | None = None


# The two default surfaces.
POLICIES = (
    SurfacePolicy("sofas", ("sofa", "corner_sofa", "bed_sofa"), accept=0.55),
    SurfacePolicy("all_furniture", ("sofa", "corner_sofa", "bed_sofa", "armchair", "dining_table", "coffee_table", "bed",
                                    "chair", "rug", "lamp", "storage", "desk", "outdoor"), accept=0.45, margin=0.05),
)
POLICY_FIELDS = ("accept", "reject", "margin", "completeness", "require_images", "require_price", "min_price", "max_price")


def with_policies(items: DataFrame, policies=POLICIES) -> DataFrame:
    """One row per item and surface, with that surface's thresholds; a generator, not a join."""
    rows = [F.struct(
        F.lit(p.surface).alias("surface"), F.array(*[F.lit(c) for c in p.allowed]).alias("allowed"),
        *[F.lit(getattr(p, f)).cast("boolean" if f.startswith("require") else "double").alias(f) for f in POLICY_FIELDS])
        for p in policies]
    return items.select("*", F.inline(F.array(*rows)))


def effective_policies(defaults: DataFrame, global_overrides: DataFrame, surface_overrides: DataFrame) -> DataFrame:
    """Surface override, else global override, else default, for every threshold.

    global_overrides holds at most one row; its values enter as scalars.
    """
    joined = defaults.alias("d").join(surface_overrides.alias("s"), "surface", "left")
    cols = []
    for f in POLICY_FIELDS:
        choices = []
        if f in surface_overrides.columns:
            choices.append(F.col(f"s.{f}"))
        if f in global_overrides.columns:
            choices.append(global_overrides.agg(F.first(f, ignorenulls=True)).scalar())
        if f in defaults.columns:
            choices.append(F.col(f"d.{f}"))
        if choices:
            cols.append(F.coalesce(*choices).alias(f))
    return joined.select("surface", F.col("d.allowed").alias("allowed"), *cols)


def evaluate_eligibility(rows: DataFrame) -> DataFrame:
    """Add decision and reason_codes to rows that carry a classification and a policy.

    Order: category, required fields and price bounds reject; unknown is
    uncertain; thresholds accept or reject; the rest is uncertain.
    """
    c = F.col
    cat, conf = c("primary_category"), c("top1_confidence")
    two = lambda x: F.format_string("%.2f", x)
    foreign = ~F.array_contains("allowed", cat) & (cat != "unknown")
    gates = F.array_compact(F.array(
        F.when(c("require_images") & ~c("has_images"), "missing_images"),
        F.when(c("require_price") & c("price_amount").isNull(), "missing_price"),
        F.when(c("completeness_score") < c("completeness"), F.concat(F.lit("low_completeness:"), two(c("completeness_score")))),
        F.when(c("price_amount") > c("max_price"), F.concat(F.lit("price_above_max:"), c("price_amount").cast("string"))),
        F.when(c("price_amount") < c("min_price"), F.concat(F.lit("price_below_min:"), c("price_amount").cast("string")))))
    staged = rows.withColumns({"_foreign": foreign, "_gates": gates})
    sure = (conf >= c("accept")) & (js_round(c("top1_top2_margin"), 4) >= c("margin"))
    doubts = F.array_compact(F.array(
        F.when(conf < c("accept"), F.concat(F.lit("below_accept_threshold:"), two(conf), F.lit("<"), c("accept").cast("string"))),
        F.when(js_round(c("top1_top2_margin"), 4) < c("margin"), F.concat(F.lit("low_margin:"), two(c("top1_top2_margin")), F.lit("<"), c("margin").cast("string")))))
    decision = (
        F.when(c("_foreign") | (F.size("_gates") > 0), "REJECT").when(cat == "unknown", "UNCERTAIN")
        .when(sure, "ACCEPT").when(conf <= c("reject"), "REJECT").otherwise("UNCERTAIN"))
    reasons = (
        F.when(c("_foreign"), F.array(F.concat(F.lit("category_not_allowed:"), cat)))
        .when(F.size("_gates") > 0, c("_gates")).when(cat == "unknown", F.array(F.lit("unclassified")))
        .when(sure, F.array(F.lit("meets_thresholds")))
        .when(conf <= c("reject"), F.array(F.concat(F.lit("low_confidence:"), two(conf)))).otherwise(doubts))
    return staged.withColumns({"decision": decision, "reason_codes": reasons}).drop("_foreign", "_gates")


def reason_names(codes: Column) -> Column:
    """Reason codes without their values."""
    return F.transform(codes, lambda r: F.substring_index(r, ":", 1))


def item_outcomes(decisions: DataFrame) -> DataFrame:
    """Per item: accepted if any surface accepts, else uncertain if any is, else rejected.

    Decisions of an item sit together after with_policies, so the aggregate
    combines map-side to one row per item.
    """
    return decisions.groupBy("item_id").agg(
        F.when(F.count_if(F.col("decision") == "ACCEPT") > 0, "accepted")
        .when(F.count_if(F.col("decision") == "UNCERTAIN") > 0, "uncertain").otherwise("rejected").alias("outcome"),
        F.array_sort(F.array_compact(F.collect_list(F.when(F.col("decision") == "ACCEPT", F.col("surface"))))).alias("eligible_surfaces"))


def promote_to_gold(items: DataFrame, decisions: DataFrame, columns: list[str]) -> DataFrame:
    """Accepted items with their eligible surfaces and the copied columns."""
    accepted = item_outcomes(decisions).where(F.col("outcome") == "accepted").select("item_id", "eligible_surfaces")
    return items.select("item_id", *columns).join(accepted, "item_id")


def to_review_queue(decisions: DataFrame) -> DataFrame:
    return item_outcomes(decisions).where(F.col("outcome") == "uncertain").select("item_id", F.lit("pending").alias("status"))


def batch_counts(decisions: DataFrame) -> DataFrame:
    return item_outcomes(decisions).groupBy("outcome").agg(F.count("*").alias("items"))


# ---- training rules --------------------------------------------------------------------------


def assess_training_rules(rows: DataFrame, rules: DataFrame, source_rules: DataFrame) -> DataFrame:
    """Add would_reject and rule_reasons from mined rules.

    rules: (source_id, primary_category, reject_tokens, min_confidence, runtime_status);
    source_rules: (source_id, require_images). Both are tiny next to the
    items; whether they are broadcast is left to their measured size.
    """
    joined = rows.drop("require_images").join(rules, ["source_id", "primary_category"], "left").join(source_rules, "source_id", "left")
    text = F.trim(F.regexp_replace(F.lower("training_text"), "[^a-z0-9åäö]+", " "))
    staged = joined.withColumn("_text", text).withColumn(
        "matched_tokens", F.filter(F.coalesce("reject_tokens", F.array().cast("array<string>")), lambda t: F.contains("_text", t)))
    known = F.col("primary_category") != "unknown"
    reasons = F.array_compact(F.array(
        F.when(known & F.coalesce("require_images", F.lit(False)) & ~F.col("has_images"), "training_rule_missing_images"),
        F.when(known & (F.col("top1_confidence") < F.col("min_confidence")), "training_rule_min_conf"),
        F.when(known & (F.size("matched_tokens") > 0), "training_rule_reject_tokens")))
    return staged.withColumn("rule_reasons", reasons).withColumn("would_reject", F.size("rule_reasons") > 0).drop("_text")


def apply_training_rules(assessed: DataFrame, mode: str) -> DataFrame:
    """off leaves decisions alone; shadow adds shadow_decision; active rejects, with validated rules only."""
    if mode == "off":
        return assessed.withColumn("shadow_decision", F.lit(None).cast("string"))
    if mode == "shadow":
        return assessed.withColumn("shadow_decision", F.when(F.col("would_reject"), "REJECT"))
    live = F.col("would_reject") & (F.coalesce("runtime_status", F.lit("validated")) == "validated") & (F.col("decision") != "REJECT")
    return assessed.withColumns({
        "reason_codes": F.when(live, F.array_distinct(F.concat("reason_codes", "rule_reasons"))).otherwise(F.col("reason_codes")),
        "decision": F.when(live, "REJECT").otherwise(F.col("decision")),
        "shadow_decision": F.lit(None).cast("string")})
