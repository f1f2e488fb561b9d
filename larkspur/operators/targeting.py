"""Segments, session profiles and their match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.numbers import js_round
from larkspur.functions.staging import by_key
from larkspur.functions.text import norm_token, norm_tokens
from larkspur.session import materialize

# Size classes, region spellings, match weights and threshold.
SIZE_CLASSES = ("small", "medium", "large", "compact")
REGION_ALIASES = {"se": "sweden", "sverige": "sweden"}
MATCH_WEIGHTS = {"style": 0.4, "budget": 0.25, "size": 0.2, "geo": 0.15}
MATCH_THRESHOLD = 0.5


def region_token(c: Column) -> Column:
    t = norm_token(c)
    aliases = F.create_map(*[F.lit(x) for kv in REGION_ALIASES.items() for x in kv])
    return F.coalesce(aliases[t], t)


def region_of_locale(c: Column) -> Column:
    t = norm_token(c)
    return F.when(F.contains(t, F.lit("sv")) | F.rlike(t, F.lit("[-_]se$")) | (t == "se"), "sweden")


def postcode_token(c: Column) -> Column:
    t = F.regexp_replace(F.upper(c), r"\s+", "")
    return F.when(F.rlike(t, F.lit("^[A-Z0-9-]{2,12}$")), t)


def normalize_criteria(segments: DataFrame) -> DataFrame:
    """Clean criteria plus `issues` (field:message) of each segment.

    Needs style_tags, size_classes (arrays), budget_min, budget_max, geo_region;
    geo_city and geo_postcodes are optional.
    """
    c = F.col
    sizes = F.array_distinct(norm_tokens(c("size_classes")))
    known = F.filter(sizes, lambda s: s.isin(*SIZE_CLASSES))
    unknown = F.filter(sizes, lambda s: ~s.isin(*SIZE_CLASSES))
    money = lambda n: F.when(c(n) >= 0, c(n))
    city = norm_token(c("geo_city")) if "geo_city" in segments.columns else F.lit(None).cast("string")
    codes = F.coalesce(c("geo_postcodes"), F.array().cast("array<string>")) if "geo_postcodes" in segments.columns else F.array().cast("array<string>")
    good_codes = F.array_distinct(F.array_compact(F.transform(codes, postcode_token)))
    issues = F.concat(
        F.transform(unknown, lambda s: F.concat(F.lit("sizeClasses:contains unsupported value '"), s, F.lit("'"))),
        F.array_compact(F.array(
            F.when(c("budget_min") < 0, "budgetMin:must be >= 0"), F.when(c("budget_max") < 0, "budgetMax:must be >= 0"),
            F.when(F.exists(codes, lambda p: postcode_token(p).isNull()), "geoPostcodes:contains invalid postcode value"),
            F.when(money("budget_min") > money("budget_max"), "budgetMin/budgetMax:budgetMin cannot be greater than budgetMax"))))
    return segments.withColumns({
        "issues": issues, "style_tags": F.array_distinct(norm_tokens(c("style_tags"))), "size_classes": known,
        "budget_min": money("budget_min"), "budget_max": money("budget_max"), "geo_region": region_token(c("geo_region")),
        "geo_city": city, "geo_postcodes": good_codes})


def session_profiles(weights: DataFrame, sessions: DataFrame) -> DataFrame:
    """Targeting profile per session from positive weights and stated fields.

    sessions: (session_id, style_tokens, size_classes arrays, budget_min,
    budget_max, geo_region, locale). Style keys are the un-prefixed and style:
    ones. Each session lists distinct keys of its own weights.
    """
    pos = weights.where(F.col("weight") > 0).withColumn("_k", norm_token(F.col("key")))
    value = F.substring_index("_k", ":", -1)
    prefix = F.when(F.contains("_k", F.lit(":")), F.substring_index("_k", ":", 1)).otherwise("style")
    lists = pos.groupBy("session_id").agg(
        F.collect_set(F.when(prefix == "style", value)).alias("_styles"),
        F.collect_set(F.when((prefix == "size") & value.isin(*SIZE_CLASSES), value)).alias("_sizes"))
    empty = F.array().cast("array<string>")
    lo, hi = F.when(F.col("budget_min") >= 0, F.col("budget_min")), F.when(F.col("budget_max") >= 0, F.col("budget_max"))
    crossed = F.coalesce(lo > hi, F.lit(False))
    both = lambda a, b: F.array_sort(F.array_distinct(F.concat(F.coalesce(a, empty), norm_tokens(b))))
    return sessions.join(lists, "session_id", "left").select(
        "session_id", both(F.col("_styles"), F.col("style_tokens")).alias("style_tags"),
        F.filter(both(F.col("_sizes"), F.col("size_classes")), lambda s: s.isin(*SIZE_CLASSES)).alias("size_classes"),
        F.when(~crossed, lo).alias("budget_min"), F.when(~crossed, hi).alias("budget_max"),
        F.coalesce(region_token(F.col("geo_region")), region_of_locale(F.col("locale")), F.lit("sweden")).alias("geo_region"))


def budget_overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Ranges overlap; a missing bound is open."""
    ends = lambda x, y: F.coalesce(F.greatest(x, y), F.lit(float("-inf")))
    return ends(a_lo, b_lo) <= F.coalesce(F.least(a_hi, b_hi), F.lit(float("inf")))


def match_columns(p: str = "p", s: str = "s") -> dict[str, Column]:
    """Match score and verdict of a joined (profile, segment) row."""
    pc, sc = (lambda n: F.col(f"{p}.{n}")), (lambda n: F.col(f"{s}.{n}"))
    share = lambda n: F.size(F.array_intersect(sc(n), pc(n))) / F.size(sc(n))
    need = {"style": F.size(sc("style_tags")) > 0, "budget": sc("budget_min").isNotNull() | sc("budget_max").isNotNull(),
            "size": F.size(sc("size_classes")) > 0, "geo": sc("geo_region").isNotNull()}
    known = pc("budget_min").isNotNull() | pc("budget_max").isNotNull()
    overlap = known & budget_overlap(sc("budget_min"), sc("budget_max"), pc("budget_min"), pc("budget_max"))
    score = {"style": share("style_tags"), "budget": overlap.cast("double"), "size": share("size_classes"),
             "geo": F.coalesce(pc("geo_region") == sc("geo_region"), F.lit(False)).cast("double")}
    total = sum((F.when(need[k], w).otherwise(0.0) for k, w in MATCH_WEIGHTS.items()), F.lit(0.0))
    got = sum((F.when(need[k], score[k] * w).otherwise(0.0) for k, w in MATCH_WEIGHTS.items()), F.lit(0.0))
    full = F.lit(True)
    for k in need:
        full = full & (~need[k] | (score[k] > 0))
    return {"match_score": js_round(F.when(total > 0, got / total).otherwise(1.0), 4), "all_required": full}


PROFILE_FIELDS = ("style_tags", "size_classes", "budget_min", "budget_max", "geo_region")


ANY = "*"  # in place of a value that a segment does not ask for
HOT_ROWS, SALTS = 1 << 16, 32


def _index(rows: DataFrame, region: Column, styles: Column, sizes: Column) -> DataFrame:
    """A row for each (region, style, size) key of the given lists."""
    return (rows.withColumn("_region", F.explode(region)).withColumn("_style", F.explode(styles)).withColumn("_size", F.explode(sizes)))


def _clean(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in ("style_tags", "size_classes")})


def match_segments(profiles: DataFrame, segments: DataFrame, threshold: float = MATCH_THRESHOLD, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """(session_id, segment_id, match_score) of matching pairs.

    A score depends only on what kind of profile and segment meet: their styles, sizes, region and whether a budget is
    known or asked for. Where kinds are much fewer than rows, kinds are matched and scored, and a pair of rows costs two
    comparisons of budgets; else the rows themselves are matched, see `match_rows`.
    """
    low, high = F.coalesce("budget_min", F.lit(float("-inf"))), F.coalesce("budget_max", F.lit(float("inf")))
    stated = F.col("budget_min").isNotNull() | F.col("budget_max").isNotNull()
    rows = lambda df, own, budget, *bounds: _clean(df).select(own, F.array_sort("style_tags").alias("style_tags"), F.array_sort("size_classes").alias("size_classes"), "geo_region", budget.alias("_budget"), *bounds)
    p = rows(profiles, "session_id", stated & (low <= high), low.alias("_plo"), high.alias("_phi"))
    # a segment that asks for no budget meets every range; NaN is the greatest value
    s = rows(segments.where(~stated | (low <= high)), "segment_id", stated, F.when(stated, low).otherwise(float("-inf")).alias("_slo"), F.when(stated, high).otherwise(float("nan")).alias("_shi"))
    kinds_p, kinds_s = _kinds(p, "_pk"), _kinds(s, "_sk")
    count = lambda df, n: df.agg(F.sum(n)).first()[0] or 0
    if kinds_p.count() * kinds_s.count() * KIND_ROWS > count(kinds_p, "_np") * count(kinds_s, "_ns"):
        return match_rows(profiles, segments, threshold, hot_rows, salts)
    as_rows = lambda kinds, own: kinds.select(F.col(own), "style_tags", "size_classes", "geo_region", F.when(F.col("_budget"), 0.0).alias("budget_min"), F.lit(None).cast("double").alias("budget_max"))
    scored = match_rows(as_rows(kinds_p, "_pk").withColumnRenamed("_pk", "session_id"), as_rows(kinds_s, "_sk").withColumnRenamed("_sk", "segment_id"), threshold, hot_rows, salts)
    named = scored.select(F.col("session_id").alias("_pk"), F.col("segment_id").alias("_sk"), "match_score")
    met = materialize(named.join(kinds_p.select("_pk", "_np"), "_pk").join(kinds_s.select("_sk", "_ns"), "_sk"), "segment-kinds")
    return _expand(_with_kind(p, kinds_p, "_pk"), _with_kind(s, kinds_s, "_sk"), met)


KIND = ("style_tags", "size_classes", "geo_region", "_budget")
KIND_ROWS = 16  # pairs of rows a pair of kinds, at least, where matching goes by kinds
GROUPS, GROUP_PAIRS = 512, 1 << 16  # groups that the pairs of rows are dealt over, and the least pairs of one


def _kinds(rows: DataFrame, name: str) -> DataFrame:
    """Distinct kinds of the rows, numbered, with their rows; written once, so that a number is one kind."""
    counted = rows.groupBy(*KIND).agg(F.count("*").alias("_n" + name[1]))
    return materialize(counted.withColumn(name, F.monotonically_increasing_id()), "kinds")


def _with_kind(rows: DataFrame, kinds: DataFrame, name: str) -> DataFrame:
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KIND]
    return rows.alias("r").join(kinds.alias("k"), same[0] & same[1] & same[2] & same[3]).select(*[f"r.{c}" for c in rows.columns if c not in KIND], f"k.{name}")


def _expand(p: DataFrame, s: DataFrame, met: DataFrame) -> DataFrame:
    """Rows of the kinds that meet, where their budgets do.

    The side that has fewer rows in all meetings is repeated for each kind that it meets, so rows join by the other's
    kind. Kinds with many pairs are dealt over salts in proportion, so that all groups have about the same number.
    """
    all_p, all_s, total = met.agg(F.sum("_np"), F.sum("_ns"), F.sum(F.col("_np") * F.col("_ns"))).first()
    key, other = ("_pk", "_sk") if (all_s or 0) <= (all_p or 0) else ("_sk", "_pk")
    share = max((total or 0) / GROUPS, GROUP_PAIRS)
    work = met.groupBy(key).agg(F.ceil(F.sum(F.col("_np") * F.col("_ns")) / share).alias("_salts"))
    repeat = lambda rows: rows.join(met.select("_pk", "_sk", "match_score"), other)
    p, s = (p, repeat(s)) if key == "_pk" else (repeat(p), s)
    left = by_key(p.join(work, key).withColumn("_salt", F.pmod(F.xxhash64("session_id"), "_salts")), key, "_salt")
    right = by_key(s.join(work, key).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))), key, "_salt")
    pairs = left.alias("l").join(right.alias("r").hint("shuffle_hash"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._salt") == F.col("r._salt"))
                                 & (F.col("_slo") <= F.col("_phi")) & (F.col("_plo") <= F.col("_shi")))
    return pairs.select("session_id", "segment_id", "match_score")


def match_rows(profiles: DataFrame, segments: DataFrame, threshold: float = MATCH_THRESHOLD, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """`match_segments` row by row, through an inverted index.

    A segment stands under every key (region, style, size) that satisfies it, a dimension it does not ask for as ANY; a
    profile looks under each of its own values and ANY. So a pair meets only where region, style and size agree, and its
    budgets are tested inside the join; it is kept under the least of its common keys, once. Profile keys of `hot_rows`
    rows or more are dealt over salts, and the segments under them repeated for each salt.
    """
    some = lambda v: F.concat(v, F.array(F.lit(ANY)))
    asked = lambda v: F.when(F.size(v) > 0, v).otherwise(F.array(F.lit(ANY)))
    pack = lambda df, key, x: df.select(key, F.struct(*PROFILE_FIELDS).alias(x))
    p, s = pack(_clean(profiles), "session_id", "p"), pack(_clean(segments), "segment_id", "s")
    left = _index(p, F.array_compact(F.array(F.col("p.geo_region"), F.lit(ANY))), some(F.col("p.style_tags")), some(F.col("p.size_classes")))
    right = _index(s, F.array(F.coalesce("s.geo_region", F.lit(ANY))), asked(F.col("s.style_tags")), asked(F.col("s.size_classes")))
    keys = ["_region", "_style", "_size"]
    left = left.join(right.select(*keys).distinct(), keys, "left_semi")  # keys that some segment stands under
    hot = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_rows).select(*keys, F.lit(salts).alias("_salts"))
    width = F.coalesce("_salts", F.lit(1))
    left = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("session_id"), width).cast("int")).drop("_salts")
    right = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), width - 1))).drop("_salts")
    common = lambda x: F.coalesce(F.array_min(F.array_intersect(F.col(f"p.{x}"), F.col(f"s.{x}"))), F.lit(ANY))
    asks = F.col("s.budget_min").isNotNull() | F.col("s.budget_max").isNotNull()
    knows = F.col("p.budget_min").isNotNull() | F.col("p.budget_max").isNotNull()
    fits = ~asks | (knows & budget_overlap(F.col("s.budget_min"), F.col("s.budget_max"), F.col("p.budget_min"), F.col("p.budget_max")))
    once = (F.col("l._style") == F.when(F.size("s.style_tags") > 0, common("style_tags")).otherwise(ANY)) & (
        F.col("l._size") == F.when(F.size("s.size_classes") > 0, common("size_classes")).otherwise(ANY))
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_salt"]]
    pairs = left.alias("l").join(right.alias("r"), same[0] & same[1] & same[2] & same[3] & fits & once)
    scored = pairs.withColumns(match_columns())
    return scored.where(F.col("all_required") & (F.col("match_score") >= threshold)).select("session_id", "segment_id", "match_score")


def match_pairs(pairs: DataFrame, profiles: DataFrame, segments: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """(session_id, segment_id, match_score) of those given pairs that match, as `match_segments` scores them.

    Where the pairs are known, only these are scored: the rows are those of `pairs`, however many others match.
    """
    p = _clean(profiles).select("session_id", F.struct(*PROFILE_FIELDS).alias("p"))
    s = _clean(segments).select("segment_id", F.struct(*PROFILE_FIELDS).alias("s"))
    asked = pairs.where(F.col("segment_id").isNotNull()).select("session_id", "segment_id").distinct()
    scored = asked.join(p, "session_id").join(s, "segment_id").withColumns(match_columns())
    return scored.where(F.col("all_required") & (F.col("match_score") >= threshold)).select("session_id", "segment_id", "match_score")


def prefix_counts(points: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, below): how many points of the probe's group lie below its value. points: (group, value); probes: (id, group, value).

    Points and probes are sorted together over ranges of (group, value). A range counts its own points; what the ranges
    before it hold of the same group is added from a table of one row per range and group. So one group in nearly all
    rows is spread over all ranges.
    """
    both = points.select("group", "value", F.lit(1).alias("point"), F.lit(None).cast(probes.schema["id"].dataType).alias("id")).unionByName(
        probes.select("group", "value", F.lit(0).alias("point"), "id"))
    ranged = materialize(both.repartitionByRange("group", "value").withColumn("range", F.spark_partition_id()), "ranged-points")
    totals = ranged.groupBy("group", "range").agg(F.sum("point").alias("n"))
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum("point").over(Window.partitionBy("group", "range").orderBy("value", "point").rowsBetween(Window.unboundedPreceding, 0))
    counted = ranged.withColumn("own", own).where(F.col("point") == 0)
    return counted.join(before, ["group", "range"]).select("id", (F.col("own") + F.col("before")).alias("below"))


def overlap_counts(profiles: DataFrame, segments: DataFrame) -> DataFrame:
    """(session_id, overlapping): segments of the profile's region whose budget range meets its own; none, no row.

    profiles: (session_id, geo_region, budget_min, budget_max); segments alike without the id. Of the region's segments
    those that end below the profile's range and those that begin above it do not meet it, and none does both; so three
    counts of sorted end points are enough and no pair is formed. Missing bounds are open; crossed ranges meet nothing.
    """
    low, high = F.coalesce("budget_min", F.lit(float("-inf"))), F.coalesce("budget_max", F.lit(float("inf")))
    fit = lambda df: df.where(F.col("geo_region").isNotNull() & (low <= high)).select("*", low.alias("_lo"), high.alias("_hi"))
    p, s = fit(profiles), fit(segments)
    total = s.groupBy("geo_region").agg(F.count("*").alias("_all"))
    points = lambda c: s.select(F.col("geo_region").alias("group"), c.alias("value"))
    probes = lambda c: p.select(F.col("session_id").alias("id"), F.col("geo_region").alias("group"), c.alias("value"))
    ends = prefix_counts(points(F.col("_hi")), probes(F.col("_lo"))).select(F.col("id").alias("session_id"), F.col("below").alias("_ends"))
    begins = prefix_counts(points(-F.col("_lo")), probes(-F.col("_hi"))).select(F.col("id").alias("session_id"), F.col("below").alias("_begins"))
    left = p.select("session_id", "geo_region").join(total, "geo_region").join(ends, "session_id").join(begins, "session_id")
    return left.select("session_id", (F.col("_all") - F.col("_ends") - F.col("_begins")).alias("overlapping")).where(F.col("overlapping") > 0)


def campaign_segments(campaigns: DataFrame, segments: DataFrame) -> DataFrame:
    """Criteria of each campaign: its own snapshot, else the segment table; campaigns with neither drop."""
    table = segments.select("segment_id", F.struct(*PROFILE_FIELDS).alias("_table"))
    joined = campaigns.join(table, "segment_id", "left").withColumn("criteria", F.coalesce("snapshot", "_table"))
    return joined.where(F.col("criteria").isNotNull()).withColumn(
        "from_snapshot", F.col("snapshot").isNotNull()).drop("_table", "snapshot")


def promoted_decision(candidates: DataFrame, campaigns: DataFrame, products: DataFrame, matches: DataFrame) -> DataFrame:
    """Reason why a promoted (session, item) may or may not be served.

    candidates: (session_id, item_id, campaign_id); campaigns: active ones
    (campaign_id, segment_id, product_mode); products: (campaign_id, item_id)
    of the chosen or recommended sets; matches: from match_segments.
    """
    sets = products.groupBy("campaign_id").agg(F.count("*").alias("_set_size"))
    member = products.select("campaign_id", "item_id", F.lit(True).alias("_member")).dropDuplicates()
    rows = (candidates.join(campaigns.select("campaign_id", "segment_id", "product_mode"), "campaign_id", "left")
            .join(sets, "campaign_id", "left").join(member, ["campaign_id", "item_id"], "left")
            .join(matches, ["session_id", "segment_id"], "left"))
    restricted = F.col("product_mode").isin("selected", "auto") & (F.coalesce("_set_size", F.lit(0)) > 0)
    return rows.withColumn("reason", F.when(F.col("campaign_id").isNull(), "legacy_promoted")
                           .when(F.col("segment_id").isNull(), "campaign_not_found")
                           .when(restricted & F.col("_member").isNull(), "product_set_mismatch")
                           .when(F.col("match_score").isNull(), "segment_mismatch").otherwise("eligible_campaign")).withColumn(
        "eligible", F.col("reason").isin("legacy_promoted", "eligible_campaign")).drop("_set_size", "_member")
