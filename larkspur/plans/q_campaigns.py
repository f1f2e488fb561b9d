"""Targeting, campaign, report and observability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import campaigns as C
from larkspur.operators import lookups as J
from larkspur.operators import observability as O
from larkspur.operators import targeting as T
from larkspur.plans.q_confidence import SCORES_SQL, scores
from larkspur.plans.q_joins import as_of
from larkspur.plans.q_preferences import WEIGHTS, weights
from larkspur.plans.q_quality import r4, sql_r4
from larkspur.plans.registry import query
from larkspur.session import unique_dir
from larkspur.sources import sinks

TODAY = "DATE '1999-06-15'"


def today():
    return F.expr(TODAY)


# ---- segments and profiles -------------------------------------------------------------------


def raw_segments(t):
    return t.segments_b.withColumns({"style_tags": F.array("style1", "style2"), "size_classes": F.array("size1")})


def segments(t):
    return T.normalize_criteria(raw_segments(t))


def profiles(t):
    return t.profiles_b.selectExpr("session_id", "array(style) AS style_tags", "IF(size_class IS NULL, array(), array(size_class)) AS size_classes",
                                   "budget_min", "budget_max", "geo_region")


@query("cmp_segment_issues", """SELECT segment_id, concat_ws(';', CASE WHEN size1 = 'huge' THEN 'sizeClasses:contains unsupported value ''huge''' END,
    CASE WHEN budget_min > budget_max THEN 'budgetMin/budgetMax:budgetMin cannot be greater than budgetMax' END) AS issues,
    array_to_string(list_filter([lower(style1), style2], lambda x: x IS NOT NULL), ',') AS style_tags FROM segments_b""", "segments_b")
def cmp_segment_issues(t):
    return segments(t).select("segment_id", F.array_join("issues", ";").alias("issues"), F.array_join("style_tags", ",").alias("style_tags"))


@query("cmp_session_profiles", f"""WITH {WEIGHTS}, st AS (SELECT session_id, key AS s FROM w WHERE weight > 0 AND NOT contains(key, ':') UNION SELECT session_id, style FROM profiles_b WHERE session_id IN (SELECT session_id FROM swipes_b)),
    sz AS (SELECT session_id, substr(key, 6) AS s FROM w WHERE weight > 0 AND key LIKE 'size:%' UNION SELECT session_id, size_class FROM profiles_b WHERE size_class IS NOT NULL)
    SELECT p.session_id, (SELECT string_agg(s, ',' ORDER BY s) FROM st WHERE st.session_id = p.session_id) AS style_tags, coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM sz WHERE sz.session_id = p.session_id), '') AS size_classes,
      CASE WHEN budget_min > budget_max THEN NULL ELSE budget_min END AS budget_min, CASE WHEN p.session_id % 3 = 0 THEN geo_region ELSE 'sweden' END AS geo_region
    FROM profiles_b p WHERE p.session_id IN (SELECT session_id FROM swipes_b)""", "items_b swipes_b profiles_b")
def cmp_session_profiles(t):
    base = t.profiles_b.join(t.swipes_b.select("session_id").distinct(), "session_id", "left_semi").selectExpr(
        "session_id", "array(upper(style)) AS style_tokens", "array(size_class) AS size_classes", "budget_min", "budget_max",
        "CASE WHEN session_id % 3 = 0 THEN geo_region WHEN session_id % 3 = 1 THEN 'Sverige' END AS geo_region", "'sv-SE' AS locale")
    p = T.session_profiles(weights(t), base)
    return p.select("session_id", F.array_join("style_tags", ",").alias("style_tags"), F.array_join("size_classes", ",").alias("size_classes"),
                    "budget_min", "geo_region")


_MATCH = f"""sg AS (SELECT segment_id, list_filter([lower(style1), style2], lambda x: x IS NOT NULL) AS st, CASE WHEN lower(size1) IN ('small', 'large') THEN lower(size1) END AS sz, budget_min, budget_max, geo_region FROM segments_b),
    x AS (SELECT p.session_id, s.segment_id, len(s.st) > 0 AS rs, len(list_intersect(s.st, [p.style])) / greatest(len(s.st), 1) AS ss, s.budget_min IS NOT NULL OR s.budget_max IS NOT NULL AS rb,
        CASE WHEN greatest(coalesce(s.budget_min, -1e18), p.budget_min) <= least(coalesce(s.budget_max, 1e18), p.budget_max) THEN 1 ELSE 0 END AS sb,
        s.sz IS NOT NULL AS rz, CASE WHEN s.sz = p.size_class THEN 1 ELSE 0 END AS z, s.geo_region IS NOT NULL AS rg, CASE WHEN s.geo_region = p.geo_region THEN 1 ELSE 0 END AS g FROM profiles_b p CROSS JOIN sg s),
    mt AS (SELECT session_id, segment_id, CASE WHEN rs OR rb OR rz OR rg THEN {sql_r4('(CASE WHEN rs THEN ss * 0.4::DOUBLE ELSE 0 END + CASE WHEN rb THEN sb * 0.25::DOUBLE ELSE 0 END + CASE WHEN rz THEN z * 0.2::DOUBLE ELSE 0 END + CASE WHEN rg THEN g * 0.15::DOUBLE ELSE 0 END) / (CASE WHEN rs THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN rb THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN rz THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN rg THEN 0.15::DOUBLE ELSE 0 END)')} ELSE 1.0 END AS match_score
      FROM x WHERE (NOT rs OR ss > 0) AND (NOT rb OR sb > 0) AND (NOT rz OR z > 0) AND (NOT rg OR g > 0))"""
_MV = "profiles_b segments_b"


@query("jn_segment_match", f"WITH {_MATCH} SELECT session_id, segment_id, match_score FROM mt WHERE match_score >= 0.5", _MV)
def jn_segment_match(t):
    return T.match_segments(profiles(t), segments(t))


@query("jn_budget_overlap", """SELECT p.session_id, count(*) AS overlapping FROM profiles_b p JOIN segments_b s ON s.geo_region = p.geo_region
    AND greatest(coalesce(s.budget_min, -1e18), p.budget_min) <= least(coalesce(s.budget_max, 1e18), p.budget_max) GROUP BY 1""", _MV)
def jn_budget_overlap(t):
    return T.overlap_counts(t.profiles_b, t.segments_b)


def snapshots(t):
    fields = ", ".join(f"'{f}', {f}" for f in T.PROFILE_FIELDS)
    rich = segments(t).selectExpr("segment_id", f"named_struct({fields}) AS crit")
    odd = rich.where("segment_id % 2 = 1").selectExpr("segment_id", "crit AS snapshot")
    return t.campaigns_b.join(odd, "segment_id", "left")


@query("jn_campaign_segments", """SELECT c.campaign_id, c.segment_id, c.segment_id % 2 = 1 AS from_snapshot, s.geo_region FROM campaigns_b c JOIN segments_b s ON s.segment_id = c.segment_id
    WHERE s.segment_id % 2 = 1 OR s.segment_id % 4 = 0""", "campaigns_b segments_b")
def jn_campaign_segments(t):
    out = T.campaign_segments(snapshots(t), segments(t).where("segment_id % 4 = 0"))
    return out.select("campaign_id", "segment_id", "from_snapshot", F.col("criteria.geo_region").alias("geo_region"))


@query("set_union_segments", """SELECT segment_id, CASE WHEN segment_id % 3 = 0 THEN 'template' WHEN segment_id % 2 = 0 THEN 'retailer' ELSE 'own' END AS origin FROM segments_b
    WHERE segment_id % 3 = 0 OR segment_id % 2 = 0 OR segment_id % 5 = 0""", "segments_b")
def set_union_segments(t):
    pick = lambda m, name: t.segments_b.where(f"segment_id % {m} = 0").select("segment_id", F.lit(name).alias("origin"))
    return J.visible_segments(pick(3, "template"), pick(2, "retailer"), pick(5, "own"))


# ---- campaigns -----------------------------------------------------------------------------------

_ACTIVE = f"""act AS (SELECT c.*, coalesce(d.spend, 0) AS spent_today, coalesce(spent_cents < budget_cents, true) AS budget_left, coalesce(coalesce(d.spend, 0) < budget_daily_cents, true) AS daily_left,
      CASE WHEN budget_cents IS NULL OR budget_cents <= 0 OR end_date <= start_date THEN true ELSE spent_cents <= budget_cents * greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({TODAY} - start_date) / (end_date - start_date)))
        + greatest(budget_cents * 0.2::DOUBLE, coalesce(budget_daily_cents * 0.5::DOUBLE, 0.0), 5000.0) END AS on_pace,
      {TODAY} >= start_date AND {TODAY} <= end_date AS in_schedule
    FROM campaigns_b c LEFT JOIN (SELECT campaign_id, sum(spend_cents) AS spend FROM campaign_daily_b WHERE dt = '1999-06-15' GROUP BY 1) d ON d.campaign_id = c.campaign_id)"""
_CV = "campaigns_b campaign_daily_b"


@query("cmp_active_campaigns", f"WITH {_ACTIVE} SELECT campaign_id, budget_left, daily_left, on_pace, in_schedule, status = 'active' AND budget_left AND daily_left AND on_pace AND in_schedule AS serving FROM act", _CV)
def cmp_active_campaigns(t):
    return C.active_campaigns(t.campaigns_b, t.campaign_daily_b, today()).select(
        "campaign_id", "budget_left", "daily_left", "on_pace", "in_schedule", "serving")


@query("agg_sum_daily_map", """SELECT campaign_id, sum(CASE WHEN dt >= '1995-01-01' AND dt <= '1996-12-31' THEN spend_cents ELSE 0 END)::DOUBLE AS spend_cents FROM campaign_daily_b GROUP BY 1""", "campaign_daily_b")
def agg_sum_daily_map(t):
    maps = t.campaign_daily_b.groupBy("campaign_id").agg(F.map_from_entries(F.collect_list(F.struct("dt", F.col("spend_cents").cast("double")))).alias("m"))
    return maps.select("campaign_id", C.sum_daily_map(F.col("m"), "1995-01-01", "1996-12-31").alias("spend_cents"))


@query("cmp_frequency_cap", """SELECT retailer_id, CAST(greatest(2, least(12, min(coalesce(frequency_cap, 12)))) AS BIGINT) AS frequency_cap FROM campaigns_b GROUP BY retailer_id
    UNION ALL SELECT -1, CAST(greatest(2, least(12, min(coalesce(frequency_cap, 12)))) AS BIGINT) FROM campaigns_b""", "campaigns_b")
def cmp_frequency_cap(t):
    c = t.campaigns_b
    per = c.groupBy("retailer_id").agg(F.greatest(F.lit(2), F.least(F.lit(C.DEFAULT_CAP), F.min(
        F.coalesce("frequency_cap", F.lit(C.DEFAULT_CAP))))).cast("bigint").alias("frequency_cap"))
    return per.unionByName(C.frequency_cap(c).withColumn("retailer_id", F.lit(-1)))


@query("cmp_campaign_issues", """SELECT campaign_id, concat_ws(',', CASE WHEN budget_cents <= 0 THEN 'budgetTotal' END, CASE WHEN budget_daily_cents <= 0 THEN 'budgetDaily' END,
    CASE WHEN start_date > end_date THEN 'startDate/endDate' END, CASE WHEN frequency_cap < 2 OR frequency_cap > 60 THEN 'frequencyCap' END) AS issues FROM campaigns_b""", "campaigns_b")
def cmp_campaign_issues(t):
    return C.campaign_issues(t.campaigns_b).select("campaign_id", F.array_join("issues", ",").alias("issues"))


@query("cmp_promoted_decision", f"""WITH {_MATCH}, {_ACTIVE},
    cand AS (SELECT DISTINCT session_id, item_id, CASE WHEN item_id % 4 = 0 THEN NULL ELSE 1 + item_id % (SELECT count(*) FROM supplier) END AS campaign_id FROM interactions_b),
    cp AS (SELECT * FROM act WHERE status = 'active'), ps AS (SELECT DISTINCT l_suppkey AS campaign_id, l_partkey AS item_id FROM lineitem),
    r AS (SELECT c.*, cp.segment_id, cp.product_mode, c.campaign_id IN (SELECT campaign_id FROM ps) AS has_set, ps.item_id IS NOT NULL AS member, m.match_score
      FROM cand c LEFT JOIN cp ON cp.campaign_id = c.campaign_id LEFT JOIN ps ON ps.campaign_id = c.campaign_id AND ps.item_id = c.item_id
      LEFT JOIN (SELECT * FROM mt WHERE match_score >= 0.5) m ON m.session_id = c.session_id AND m.segment_id = cp.segment_id)
    SELECT session_id, item_id, CASE WHEN campaign_id IS NULL THEN 'legacy_promoted' WHEN segment_id IS NULL THEN 'campaign_not_found' WHEN product_mode IN ('selected', 'auto') AND has_set AND NOT member THEN 'product_set_mismatch'
      WHEN match_score IS NULL THEN 'segment_mismatch' ELSE 'eligible_campaign' END AS reason FROM r""", "profiles_b segments_b campaigns_b campaign_daily_b interactions_b")
def cmp_promoted_decision(t):
    n = t.supplier.agg(F.count("*")).scalar()
    cand = t.interactions_b.select("session_id", "item_id", F.when(F.col("item_id") % 4 != 0, 1 + F.col("item_id") % n).alias("campaign_id")).distinct()
    products = t.lineitem.selectExpr("l_suppkey AS campaign_id", "l_partkey AS item_id").distinct()
    active = t.campaigns_b.where("status = 'active'")
    pairs = cand.join(active.select("campaign_id", "segment_id"), "campaign_id").select("session_id", "segment_id")
    out = T.promoted_decision(cand, active, products, T.match_pairs(pairs, profiles(t), segments(t)))
    return out.select("session_id", "item_id", "reason")


@query("agg_campaign_spend", """SELECT campaign_id, strftime(ts, '%Y-%m-%d') AS dt, count(*) AS impressions, count(*) * 100 AS spend_cents FROM featured_b GROUP BY 1, 2""", "featured_b")
def agg_campaign_spend(t):
    return C.featured_spend(t.featured_b)


_TOT = """tot AS (SELECT c.retailer_id, c.campaign_id, c.segment_id % 6 AS segment_id, c.name, c.status, coalesce(sum(d.spend_cents), 0) AS sp, coalesce(sum(d.impressions), 0) AS im, any_value(c.clicks) AS oc
    FROM campaigns_b c LEFT JOIN campaign_daily_b d ON d.campaign_id = c.campaign_id AND d.dt BETWEEN '1997-01-01' AND '1999-12-31' GROUP BY 1, 2, 3, 4, 5)"""
_R2 = lambda c: f"floor(({c}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"


def totals(t):
    return C.campaign_totals(t.campaigns_b.withColumn("segment_id", F.col("segment_id") % 6), t.campaign_daily_b, "1997-01-01", "1999-12-31")


@query("rpt_campaign", f"""WITH {_TOT}, u AS (SELECT retailer_id, 'campaign' AS level, campaign_id AS id, sum(sp) AS sp, sum(im) AS im, sum(oc) AS oc FROM tot GROUP BY 1, 3
      UNION ALL SELECT retailer_id, 'segment', segment_id, sum(sp), sum(im), sum(oc) FROM tot GROUP BY 1, 3 UNION ALL SELECT retailer_id, 'total', NULL, sum(sp), sum(im), sum(oc) FROM tot GROUP BY 1)
    SELECT retailer_id, level, coalesce(id, -1) AS id, {_R2('CAST(sp AS DOUBLE) / 100.0::DOUBLE')} AS spend, CAST(im AS BIGINT) AS impressions, CAST(oc AS BIGINT) AS outcomes_lifetime, {_R2('CASE WHEN sp > 0 THEN CAST(oc AS DOUBLE) / CAST(sp AS DOUBLE) ELSE 0 END * 10000.0::DOUBLE')} AS cp_score FROM u""", _CV)
def rpt_campaign(t):
    return C.retailer_report(totals(t)).withColumn("id", F.coalesce("id", F.lit(-1)))


@query("rpt_campaign_csv", f"""WITH {_TOT}, u AS (SELECT retailer_id AS report, CAST(retailer_id AS VARCHAR) AS retailer_id, CAST(campaign_id AS VARCHAR) AS campaign_id, name, status, sp, im, oc FROM tot
      UNION ALL SELECT retailer_id, 'TOTAL', NULL, NULL, NULL, sum(sp), sum(im), sum(oc) FROM tot GROUP BY 1)
    SELECT report, retailer_id, campaign_id, name, status, {_R2('CAST(sp AS DOUBLE) / 100.0::DOUBLE')} AS spend, CAST(im AS BIGINT) AS impressions, CAST(oc AS BIGINT) AS outcomes_lifetime,
      {_R2('CASE WHEN sp > 0 THEN CAST(oc AS DOUBLE) / CAST(sp AS DOUBLE) ELSE 0 END * 10000.0::DOUBLE')} AS cp_score FROM u""", _CV)
def rpt_campaign_csv(t):
    """Report lines written as CSV and read back."""
    path = unique_dir(t.spark, "campaign_csv")
    rows = C.report_rows(totals(t))
    sinks.write_csv_report(rows, path)
    return t.spark.read.option("header", True).schema(rows.schema).csv(path)


@query("rpt_products_top40", """WITH n AS (SELECT c.retailer_id, f.item_id, count(*) AS impressions, min(f.campaign_id) AS campaign_id FROM featured_b f JOIN campaigns_b c ON c.campaign_id = f.campaign_id GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY retailer_id ORDER BY impressions DESC, item_id) AS rank FROM n)
    SELECT r.retailer_id, r.item_id, i.title, r.impressions, r.campaign_id, r.rank FROM r JOIN items_b i ON i.item_id = r.item_id WHERE rank <= 40""", "featured_b campaigns_b items_b")
def rpt_products_top40(t):
    return C.top_products(t.featured_b, t.campaigns_b, t.items_b).select(
        "retailer_id", "item_id", "title", "impressions", "campaign_id", F.col("rank").cast("bigint").alias("rank"))


_SV = "items_b interactions_b"


@query("top_campaign_products", f"""WITH {SCORES_SQL}, u AS (SELECT i.retailer, f.item_id, 0 AS source, CAST(-f.score AS DOUBLE) AS o FROM final f JOIN items_b i ON i.item_id = f.item_id AND i.is_active WHERE f.time_window = '30d' AND f.score >= 60
      UNION ALL SELECT retailer, item_id, 1, CAST(item_id AS DOUBLE) FROM gold_b WHERE is_active UNION ALL SELECT retailer, item_id, 2, CAST(item_id AS DOUBLE) FROM items_b WHERE is_active),
    b AS (SELECT DISTINCT ON (retailer, item_id) * FROM u ORDER BY retailer, item_id, source, o)
    SELECT retailer, item_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY retailer ORDER BY source, o, item_id) AS rank FROM b) WHERE rank <= 24""", "items_b interactions_b gold_b")
def top_campaign_products(t):
    good = scores(t).where("time_window = '30d' AND score >= 60")
    return C.recommend_products(good, t.gold_b, t.items_b).withColumn("rank", F.col("rank").cast("bigint"))


@query("rpt_low_confidence", f"WITH {SCORES_SQL} SELECT item_id, score, impressions, saves FROM final WHERE time_window = '30d' AND score < 45 AND impressions >= 20 AND saves < impressions * 0.05", _SV)
def rpt_low_confidence(t):
    return C.low_confidence(scores(t)).select("item_id", "score", "impressions", "saves")


@query("rpt_underperforming", f"""SELECT campaign_id, {sql_r4('impressions / (budget_cents / 100.0::DOUBLE) * 100.0::DOUBLE')} AS fill_rate FROM campaigns_b
    WHERE status = 'active' AND budget_cents > 0 AND impressions / (budget_cents / 100.0::DOUBLE) * 100.0::DOUBLE < 0.3""", "campaigns_b")
def rpt_underperforming(t):
    return C.underperforming(t.campaigns_b).select("campaign_id", r4(F.col("fill_rate")).alias("fill_rate"))


@query("rpt_no_traction", f"WITH {SCORES_SQL} SELECT i.item_id, f.impressions FROM items_b i JOIN final f ON f.item_id = i.item_id AND f.time_window = '7d' WHERE i.updated_day >= 351 AND f.impressions < 10", _SV)
def rpt_no_traction(t):
    return C.no_traction(t.items_b, scores(t), 351).select("item_id", "impressions")


_PACE = f"""pa AS (SELECT c.*, coalesce(d.spend, 0) AS td FROM campaigns_b c LEFT JOIN (SELECT campaign_id, sum(spend_cents) AS spend FROM campaign_daily_b WHERE dt = '1999-06-15' GROUP BY 1) d ON d.campaign_id = c.campaign_id WHERE status = 'active'),
    pk AS (SELECT *, CASE WHEN budget_daily_cents > 0 AND td / budget_daily_cents > 0.85 THEN 'daily' WHEN budget_cents > 0 AND end_date > start_date AND {TODAY} > start_date
        AND spent_cents > budget_cents * ({TODAY} - start_date) / (end_date - start_date) * 1.1 THEN 'total' END AS kind FROM pa),
    pal AS (SELECT retailer_id, campaign_id, kind, CAST(floor((CASE WHEN kind = 'daily' THEN td / budget_daily_cents ELSE spent_cents / budget_cents END) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS used_pct,
      CASE WHEN kind = 'daily' THEN CASE WHEN td > budget_daily_cents THEN 'high' ELSE 'medium' END WHEN greatest(0, end_date - {TODAY}) <= 2 THEN 'high' ELSE 'medium' END AS priority FROM pk WHERE kind IS NOT NULL)"""


@query("rpt_pacing_alerts", f"WITH {_PACE} SELECT * FROM pal", _CV)
def rpt_pacing_alerts(t):
    return C.pacing_alerts(t.campaigns_b, t.campaign_daily_b, today())


_IMP = """imp AS (SELECT item_id, max(score) FILTER (WHERE time_window = '7d') AS score_7d, max(score) FILTER (WHERE time_window = '30d') AS score_30d FROM final GROUP BY 1)"""


@query("rpt_top_improver", f"WITH {SCORES_SQL}, {_IMP} SELECT item_id, score_7d, score_30d, score_7d - score_30d AS gain FROM imp WHERE score_7d - score_30d > 5", _SV)
def rpt_top_improver(t):
    return C.score_improvers(scores(t))


@query("rpt_insights", f"""WITH {SCORES_SQL}, {_IMP}, {_PACE}, run AS (SELECT DISTINCT retailer_id FROM campaigns_b WHERE status = 'active'),
    lo AS (SELECT i.retailer AS retailer_id, count(*) AS n, avg(score) AS m FROM final f JOIN items_b i ON i.item_id = f.item_id WHERE time_window = '30d' AND score < 45 AND impressions >= 20 AND saves < impressions * 0.05 GROUP BY 1),
    un AS (SELECT retailer_id, min(impressions / (budget_cents / 100.0::DOUBLE) * 100.0::DOUBLE) AS w FROM campaigns_b WHERE status = 'active' AND budget_cents > 0 GROUP BY 1 HAVING w < 0.3),
    nt AS (SELECT i.retailer AS retailer_id, count(*) AS n FROM items_b i JOIN final f ON f.item_id = i.item_id AND f.time_window = '7d' WHERE i.updated_day >= 351 AND f.impressions < 10 GROUP BY 1),
    im2 AS (SELECT i.retailer AS retailer_id, max(score_7d - score_30d) AS g FROM imp JOIN items_b i ON i.item_id = imp.item_id WHERE score_7d - score_30d > 5 GROUP BY 1)
    SELECT retailer_id, 'low_confidence_score' AS type, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS priority, CAST(floor(m + 0.5) AS BIGINT) AS metric FROM lo WHERE retailer_id IN (SELECT retailer_id FROM run)
    UNION ALL SELECT retailer_id, 'campaign_underperforming', CASE WHEN w < 0.1 THEN 'high' ELSE 'medium' END, CAST(floor(w * 1000.0::DOUBLE + 0.5) AS BIGINT) FROM un
    UNION ALL SELECT retailer_id, 'new_products_no_traction', CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END, n FROM nt
    UNION ALL SELECT retailer_id, 'budget_pacing', arg_min(priority, campaign_id), arg_min(used_pct, campaign_id) FROM pal GROUP BY 1
    UNION ALL SELECT retailer_id, 'top_performer', 'low', g FROM im2 WHERE retailer_id IN (SELECT retailer_id FROM run)
    UNION ALL SELECT r.retailer_id, 'no_active_campaigns', CASE WHEN count(c.campaign_id) = 0 THEN 'high' ELSE 'medium' END, count(c.campaign_id)
      FROM (SELECT retailer AS retailer_id FROM items_b UNION SELECT retailer_id FROM campaigns_b) r LEFT JOIN campaigns_b c ON c.retailer_id = r.retailer_id WHERE r.retailer_id NOT IN (SELECT retailer_id FROM run) GROUP BY 1""",
       "items_b interactions_b campaigns_b campaign_daily_b")
def rpt_insights(t):
    campaigns = t.campaigns_b.withColumn("retailer_id", F.col("retailer_id").cast("bigint"))
    return C.insights(t.items_b, campaigns, t.campaign_daily_b, scores(t), today(), 351)


_DAYS = """dy AS (SELECT campaign_id, budget_cents AS b, end_date - start_date + 1 AS n, start_date, unnest(range(0, end_date - start_date + 1)) AS i FROM campaigns_b WHERE budget_cents > 0 AND start_date <= end_date)"""
_ALLOC = """wt AS (SELECT *, CAST(floor(b * (w / sum(w) OVER (PARTITION BY campaign_id, strategy)) + 0.5::DOUBLE) AS BIGINT) AS sh FROM ww),
    cm AS (SELECT *, least(b, sum(sh) OVER (PARTITION BY campaign_id, strategy ORDER BY i)) AS cum, max(i) OVER (PARTITION BY campaign_id, strategy) AS last FROM wt),
    al AS (SELECT *, CAST(CASE WHEN i = last THEN b ELSE cum END - coalesce(lag(cum) OVER (PARTITION BY campaign_id, strategy ORDER BY i), 0) AS BIGINT) AS cents FROM cm)"""


@query("win_pacing_daily", f"""WITH {_DAYS}, ww AS (SELECT *, 'frontload' AS strategy, pow(CAST(n - i AS DOUBLE), 1.5::DOUBLE) AS w FROM dy UNION ALL SELECT *, 'backload', pow(CAST(i + 1 AS DOUBLE), 1.5::DOUBLE) FROM dy), {_ALLOC}
    SELECT campaign_id, strategy, strftime(start_date + CAST(i AS INT), '%Y-%m-%d') AS day, cents FROM al
    UNION ALL SELECT campaign_id, 'even', strftime(start_date + CAST(i AS INT), '%Y-%m-%d'), CAST(b // n + CASE WHEN i < b % n THEN 1 ELSE 0 END AS BIGINT) FROM dy""", "campaigns_b")
def win_pacing_daily(t):
    one = lambda s: C.pacing_daily(t.campaigns_b, s).select(
        "campaign_id", F.lit(s).alias("strategy"), F.date_format("day", "yyyy-MM-dd").alias("day"), "cents")
    return one("even").unionByName(one("frontload")).unionByName(one("backload"))


@query("win_pacing_hourly", f"""WITH hr AS (SELECT campaign_id, budget_daily_cents AS b, unnest(range(0, 24)) AS i FROM campaigns_b WHERE budget_daily_cents > 0),
    ww AS (SELECT *, 'frontload' AS strategy, CASE WHEN i >= 8 AND i < 12 THEN 3.0::DOUBLE WHEN i >= 6 AND i < 23 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS w FROM hr
      UNION ALL SELECT *, 'backload', CASE WHEN i >= 18 AND i < 22 THEN 3.0::DOUBLE WHEN i >= 6 AND i < 23 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END FROM hr), {_ALLOC}
    SELECT campaign_id, strategy, CAST(i AS INT) AS hour, cents FROM al UNION ALL SELECT campaign_id, 'even', CAST(i AS INT), CAST(b // 24 + CASE WHEN i < b % 24 THEN 1 ELSE 0 END AS BIGINT) FROM hr""", "campaigns_b")
def win_pacing_hourly(t):
    one = lambda s: C.pacing_hourly(t.campaigns_b, s).select("campaign_id", F.lit(s).alias("strategy"), "hour", "cents")
    return one("even").unionByName(one("frontload")).unionByName(one("backload"))


# ---- observability -----------------------------------------------------------------------------------

_A = "a AS (SELECT max(ts) AS m FROM {t})"
_PCT = lambda a, b: f"floor((CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0::DOUBLE END) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"


@query("obs_funnel", f"""WITH {_A.format(t='funnel_b')}, n AS (SELECT f.* FROM funnel_b f, a WHERE ts >= m - INTERVAL 1 DAY),
    c AS (SELECT count(*) FILTER (WHERE event_name = 'intro_shown') AS shown, count(*) FILTER (WHERE event_name = 'step_viewed') AS viewed, count(*) FILTER (WHERE event_name = 'step_completed') AS completed,
      count(*) FILTER (WHERE event_name = 'summary_confirmed') AS confirmed, count(*) FILTER (WHERE event_name = 'skipped') AS skipped, count(DISTINCT CASE WHEN event_name = 'summary_confirmed' THEN session_id END) AS attempted_sessions FROM n),
    d AS (SELECT count(*) AS completed_profiles FROM customer WHERE c_custkey % 75 = 0)
    SELECT shown, viewed, completed, confirmed, skipped, attempted_sessions, completed_profiles, {_PCT('confirmed', 'shown')} AS completion_rate_pct, {_PCT('skipped', 'shown')} AS skip_rate_pct,
      {_PCT('greatest(0, attempted_sessions - completed_profiles)', 'attempted_sessions')} AS submit_failure_pct, attempted_sessions >= 20 AND greatest(0, attempted_sessions - completed_profiles) / attempted_sessions > 0.02 AS submit_alert FROM c, d""", "funnel_b")
def obs_funnel(t):
    return O.funnel(t.funnel_b, t.customer.where("c_custkey % 75 = 0"), t.funnel_b.agg(F.max("ts")).scalar())


def deck_now(t):
    return t.deck_responses_b.agg(F.max("ts")).scalar()


@query("obs_latency_p95", f"""WITH {_A.format(t='deck_responses_b')}, s AS (SELECT latency_ms, ts >= m - INTERVAL 30 DAY AS cur FROM deck_responses_b, a WHERE ts >= m - INTERVAL 210 DAY),
    p AS (SELECT quantile_disc(latency_ms, 0.95) FILTER (WHERE cur) AS p95_current, quantile_disc(latency_ms, 0.95) FILTER (WHERE NOT cur) AS p95_baseline, count(*) FILTER (WHERE cur) AS current_samples, count(*) FILTER (WHERE NOT cur) AS baseline_samples FROM s)
    SELECT *, {_PCT('(p95_current - p95_baseline)', 'p95_baseline')} AS regression_pct, current_samples >= 30 AND baseline_samples >= 30 AND (p95_current - p95_baseline) / p95_baseline > 0.15 AS alert FROM p""", "deck_responses_b")
def obs_latency_p95(t):
    return O.latency_regression(t.deck_responses_b, deck_now(t), 30, 210)


@query("obs_deck_quality", f"""WITH {_A.format(t='deck_responses_b')}, s AS (SELECT count(*) AS samples, avg(same_family_top8_rate) AS rep, avg(style_distance_top4_min) AS dist, count(*) FILTER (WHERE fallback_stage = 'recycled_seen_items') AS recycled,
      count(*) FILTER (WHERE fallback_stage = 'catalog_exhausted') AS exhausted FROM deck_responses_b, a WHERE ts >= m - INTERVAL 90 DAY)
    SELECT samples, {sql_r4('rep')} AS same_family_top8_rate, {sql_r4('dist')} AS style_distance_top4_min, recycled, exhausted, {sql_r4('recycled / samples')} AS recycled_rate, {sql_r4('exhausted / samples')} AS exhausted_rate,
      samples >= 20 AND rep > 0.2 AS repeat_alert, samples >= 20 AND (exhausted > 0 OR recycled / samples > 0.08) AS fallback_alert FROM s""", "deck_responses_b")
def obs_deck_quality(t):
    return O.deck_quality(t.deck_responses_b, deck_now(t), 90)


@query("obs_weekly_cohorts", f"""WITH {_A.format(t='funnel_b')}, w AS (SELECT f.* FROM funnel_b f, a WHERE ts >= m - INTERVAL 7 DAY),
    fv AS (SELECT session_id, arg_min(rank_variant, struct_pack(a := ts, b := event_id)) AS v FROM w WHERE rank_variant IS NOT NULL GROUP BY 1),
    t AS (SELECT w.*, coalesce(rank_variant, v, 'unknown') AS cohort FROM w LEFT JOIN fv USING (session_id)),
    g AS (SELECT cohort, count(DISTINCT session_id) AS sessions, count(DISTINCT CASE WHEN event_name = 'intro_shown' THEN session_id END) AS intro_sessions, count(DISTINCT CASE WHEN event_name = 'summary_confirmed' THEN session_id END) AS confirmed_sessions,
      count(DISTINCT CASE WHEN event_name = 'skipped' THEN session_id END) AS skipped_sessions, count(*) FILTER (WHERE event_name = 'swipe_right') AS swipes_right, count(*) FILTER (WHERE event_name = 'swipe_left') AS swipes_left,
      count(*) FILTER (WHERE event_name = 'deck_response') AS deck_responses, avg(same_family_top8_rate) FILTER (WHERE event_name = 'deck_response') AS rep FROM t GROUP BY 1)
    SELECT cohort, sessions, intro_sessions, confirmed_sessions, skipped_sessions, {_PCT('confirmed_sessions', 'intro_sessions')} AS completion_rate_pct, {_PCT('skipped_sessions', 'intro_sessions')} AS skip_rate_pct, swipes_right, swipes_left,
      {_PCT('swipes_right', '(swipes_right + swipes_left)')} AS right_rate_pct, deck_responses, {_R2('rep')} AS same_family_rate FROM g""", "funnel_b")
def obs_weekly_cohorts(t):
    return O.weekly_cohorts(t.funnel_b, t.funnel_b.agg(F.max("ts")).scalar())


@query("obs_totals", f"""SELECT (SELECT count(DISTINCT session_id) FROM interactions_b WHERE ts >= (SELECT max(ts) FROM interactions_b) - INTERVAL 1 DAY) AS daily_sessions, (SELECT count(*) FROM swipes_b) AS swipes, (SELECT count(*) FROM likes_i) AS likes,
    (SELECT count(*) FROM interactions_b WHERE event_type = 'click') AS outbound_clicks, floor((SELECT count(*) FROM likes_i) / (SELECT count(*) FROM swipes_b) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS like_rate_pct""",
       "interactions_b swipes_b likes_i")
def obs_totals(t):
    day = t.interactions_b.where(F.col("ts") >= as_of(t) - F.make_dt_interval(F.lit(1))).select("session_id").distinct()
    return O.totals(day, t.swipes_b, t.likes_i, t.interactions_b.where("event_type = 'click'"))
