"""Ranking, retrieval, shaping and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions.text import error_label
from larkspur.operators import evaluate as E
from larkspur.operators import preferences as P
from larkspur.operators import ranking as R
from larkspur.operators import shaping as S
from larkspur.operators.review import recipe_gate
from larkspur.plans.q_joins import as_of
from larkspur.plans.q_preferences import BOUNDS, PERSONA, TOP14, WEIGHTS, personas, weights
from larkspur.plans.q_quality import r4, sql_r4
from larkspur.plans.registry import query
from larkspur.session import materialize

_V = "items_b swipes_b"
PAIR = f"""{WEIGHTS}, pair AS (SELECT w.session_id, f.item_id, CAST(sum(weight) AS DOUBLE) / sqrt(CAST(count(*) AS DOUBLE)) AS score, count(*) AS signals
    FROM w JOIN feat f USING (key) WHERE weight <> 0 GROUP BY ALL)"""


def topk_sql(k: int) -> str:
    return f"{PAIR}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item_id) AS rank FROM pair) WHERE rank <= {k})"


def ranked(t, k: int):
    return R.preference_topk(weights(t), t.items_b, k, BOUNDS)


@query("rnk_preference_topk", f"WITH {topk_sql(20)} SELECT session_id, item_id, {sql_r4('score')} AS score, signals, rank FROM top", _V)
def rnk_preference_topk(t):
    return ranked(t, 20).select("session_id", "item_id", r4(F.col("score")).alias("score"), "signals", F.col("rank").cast("bigint").alias("rank"))


@query("rnk_score_stats", f"""WITH {topk_sql(100)} SELECT session_id, count(*) AS total, count(*) FILTER (WHERE score > 0) AS non_zero, {sql_r4('min(score)')} AS min_score,
    {sql_r4('max(score)')} AS max_score, {sql_r4('avg(score)')} AS avg_score FROM top GROUP BY session_id""", _V)
def rnk_score_stats(t):
    s = R.score_stats(ranked(t, 100))
    return s.withColumns({c: r4(F.col(c)) for c in ("min_score", "max_score", "avg_score")})


def session_personas(t):
    sessions = t.interactions_b.selectExpr("session_id", "session_id % 12 AS pick_hash").distinct()
    return sessions.join(personas(t).select("pick_hash", "item_id", "normalized_score", "rank"), "pick_hash")


@query("rnk_persona_blend", f"""WITH {topk_sql(60)}, {PERSONA}, sp AS (SELECT k.session_id, p.item_id, p.normalized_score AS ps FROM picks k JOIN per p USING (pick_hash)),
    u AS (SELECT coalesce(t.session_id, s.session_id) AS session_id, coalesce(t.item_id, s.item_id) AS item_id, coalesce(t.score, 0) AS score, coalesce(t.signals, 0) AS signals, coalesce(s.ps, 0) AS ps
      FROM top t FULL JOIN sp s ON t.session_id = s.session_id AND t.item_id = s.item_id),
    m AS (SELECT *, max(ps) OVER (PARTITION BY session_id) AS mx, session_id IN (SELECT session_id FROM w WHERE weight <> 0) AS hw FROM u),
    b AS (SELECT *, CASE WHEN NOT hw THEN 0.0::DOUBLE WHEN signals = 0 THEN 0.2::DOUBLE ELSE 0.7::DOUBLE END AS a FROM m),
    f AS (SELECT session_id, item_id, floor((CASE WHEN mx > 0 THEN a * score + (1.0::DOUBLE - a) * (ps / mx) ELSE score END) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score FROM b)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 20""", "items_b swipes_b interactions_b likes_i")
def rnk_persona_blend(t):
    w = weights(t)
    persona = session_personas(t).selectExpr("session_id", "item_id", "normalized_score AS persona_score", "cast(null AS int) AS popularity")
    known = w.where("weight <> 0").select("session_id", F.lit(True).alias("has_weights")).distinct()
    return R.persona_blend(R.preference_topk(w, t.items_b, 60, BOUNDS), persona, known, 20).withColumn("rank", F.col("rank").cast("bigint"))


@query("rnk_overlap", f"""WITH {WEIGHTS}, {TOP14}, o AS (SELECT t.session_id, f.item_id, sum(CASE WHEN f.key LIKE 'material:%' OR f.key LIKE 'color:%' OR NOT contains(f.key, ':') THEN 2
      WHEN regexp_matches(f.key, '^(size|brand|price_bucket):') THEN 1 ELSE 0 END) AS overlap FROM t14 t JOIN feat f USING (key) GROUP BY ALL)
    SELECT session_id, CAST(overlap AS BIGINT) AS overlap, count(*) AS items FROM o WHERE overlap > 0 GROUP BY ALL""", _V)
def rnk_overlap(t):
    return R.overlap_histogram(P.top_keys(weights(t)), t.items_b, BOUNDS)


POOL_N, CAP = 360, 240  # as in the deck job
_POOL = f"""lst AS (SELECT item_id, 0 AS li, row_number() OVER (ORDER BY updated_day DESC, item_id DESC) AS rk FROM items_b WHERE is_active AND item_id % 3 = 0
      UNION ALL SELECT item_id, 1, row_number() OVER (ORDER BY updated_day DESC, item_id DESC) FROM items_b WHERE is_active),
    one AS (SELECT item_id, arg_min(li, rk * 2 + li) AS li, min(rk * 2 + li) AS o FROM lst WHERE rk <= {POOL_N} GROUP BY item_id),
    pool AS (SELECT *, row_number() OVER (ORDER BY o) AS pos FROM (SELECT * FROM one ORDER BY o LIMIT {POOL_N}))"""


def sql_hash(expr: str) -> str:
    return (f"abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({expr}, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: "
            f"CASE WHEN ((a * 31 + x) & 4294967295) >= 2147483648 THEN ((a * 31 + x) & 4294967295) - 4294967296 ELSE ((a * 31 + x) & 4294967295) END))")


_QUEUES = f"""{WEIGHTS}, {TOP14}, {_POOL}, {PERSONA}, ses AS (SELECT DISTINCT session_id FROM w),
    ov AS (SELECT s.session_id, p.item_id, p.li, p.pos, coalesce(sum(CASE WHEN f.key LIKE 'material:%' OR f.key LIKE 'color:%' OR NOT contains(f.key, ':') THEN 2
      WHEN regexp_matches(f.key, '^(size|brand|price_bucket):') THEN 1 ELSE 0 END) FILTER (WHERE t.key IS NOT NULL), 0) AS overlap
      FROM ses s CROSS JOIN pool p JOIN feat f USING (item_id) LEFT JOIN t14 t ON t.session_id = s.session_id AND t.key = f.key GROUP BY 1, 2, 3, 4),
    q AS (SELECT session_id, 'preference_match' AS queue, row_number() OVER (PARTITION BY session_id ORDER BY overlap DESC, pos) AS rank, item_id FROM ov WHERE overlap > 0
      UNION ALL SELECT session_id, 'fresh_promoted', rk, item_id FROM ses CROSS JOIN lst WHERE li = 0 AND rk <= {POOL_N}
      UNION ALL SELECT session_id, 'fresh_catalog', rk, item_id FROM ses CROSS JOIN lst WHERE li = 1 AND rk <= {POOL_N}
      UNION ALL SELECT session_id, 'long_tail', row_number() OVER (PARTITION BY session_id ORDER BY pos), item_id FROM ov WHERE pos > floor((SELECT count(*) FROM pool) * 0.35::DOUBLE)
      UNION ALL SELECT session_id, 'serendipity', row_number() OVER (PARTITION BY session_id ORDER BY {sql_hash("session_id || ':' || item_id")}, pos), item_id FROM ov WHERE overlap = 0
      UNION ALL SELECT k.session_id, 'persona_similar', p.rank, p.item_id FROM picks k JOIN per p USING (pick_hash) WHERE k.session_id IN (SELECT session_id FROM ses))"""
_QV = "items_b swipes_b interactions_b likes_i"


def queue_inputs(t):
    w = weights(t)
    preferred = P.top_keys(w).groupBy("session_id").agg(F.collect_list("key").alias("preferred"))
    sessions = w.select("session_id").distinct().join(preferred, "session_id", "left").withColumn(
        "preferred", F.coalesce("preferred", F.array().cast("array<string>")))
    active = t.items_b.where("is_active")
    pool = R.recent_pool(active.where("item_id % 3 = 0"), active, POOL_N, [F.desc("updated_day"), F.desc("item_id")], BOUNDS)
    persona = session_personas(t).join(sessions.select("session_id"), "session_id", "left_semi")
    return sessions, R.retrieval_queues(sessions, pool, persona.select("session_id", "item_id", "rank"))


@query("rnk_retrieval_queues", f"WITH {_QUEUES} SELECT session_id, queue, rank, item_id FROM q", _QV)
def rnk_retrieval_queues(t):
    return queue_inputs(t)[1].withColumn("rank", F.col("rank").cast("bigint"))


# Quotas written out: ratios .22 .18 .30 .20 .07 .03 (known) or .24 .33 .27 .28 .15 (new) over their sum, floor, remainder in queue order.
_RATIO = """rt(queue, o, known, fresh) AS (VALUES ('preference_match', 0, 0.30::DOUBLE, 0.0::DOUBLE), ('persona_similar', 1, 0.20, 0.27), ('fresh_promoted', 2, 0.22, 0.24),
    ('fresh_catalog', 3, 0.18, 0.33), ('long_tail', 4, 0.07, 0.28), ('serendipity', 5, 0.03, 0.15)),
  rr AS (SELECT s.session_id, r.queue, r.o, CASE WHEN r.queue = 'persona_similar' AND NOT s.hs THEN 0 WHEN s.hp THEN r.known ELSE r.fresh END AS ratio FROM fl s CROSS JOIN rt r),
  fq AS (SELECT *, CASE WHEN ratio > 0 THEN greatest(1, ({cap} * round(ratio * 100)::BIGINT) // sum(round(ratio * 100)::BIGINT) OVER (PARTITION BY session_id)) ELSE 0 END AS base FROM rr),
  rem AS (SELECT *, {cap} - sum(base) OVER (PARTITION BY session_id) AS left_over, sum(CASE WHEN ratio > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS open,
     row_number() OVER (PARTITION BY session_id, ratio > 0 ORDER BY o) - 1 AS idx FROM fq),
  tgt AS (SELECT session_id, queue, CAST(base + CASE WHEN ratio > 0 AND left_over > 0 THEN floor(left_over / open) + CASE WHEN idx < left_over % open THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS quota FROM rem)"""


@query("rnk_queue_targets", f"""WITH fl AS (SELECT o_custkey AS session_id, min(o_orderkey) % 3 <> 0 AS hp, min(o_orderkey) % 5 <> 0 AS hs FROM orders GROUP BY 1), {_RATIO.format(cap=97)}
    SELECT session_id, queue, quota FROM tgt""")
def rnk_queue_targets(t):
    flags = t.orders.groupBy(F.col("o_custkey").alias("session_id")).agg(F.min("o_orderkey").alias("m")).selectExpr(
        "session_id", "m % 3 <> 0 AS has_preferences", "m % 5 <> 0 AS has_persona")
    return R.queue_targets(flags, 97).withColumn("quota", F.col("quota").cast("bigint"))


_QUOTAS = "fl AS (SELECT s.session_id, s.session_id IN (SELECT session_id FROM t14) AS hp, s.session_id IN (SELECT session_id FROM q WHERE queue = 'persona_similar') AS hs FROM ses s), " + _RATIO.format(cap=CAP)


@query("rnk_quota_merge", f"""WITH {_QUEUES}, {_QUOTAS},
    od(queue, o, bo) AS (VALUES {', '.join(f"('{x}', {i}, {R.BACKFILL_ORDER.index(x)})" for i, x in enumerate(R.QUEUE_ORDER))}),
    bst AS (SELECT session_id, item_id, arg_min(queue, rank * 10 + o) AS queue, min(rank) AS rank FROM q JOIN od USING (queue) GROUP BY 1, 2),
    qr AS (SELECT b.*, od.o, od.bo, row_number() OVER (PARTITION BY b.session_id, b.queue ORDER BY b.rank, b.item_id) AS qrank FROM bst b JOIN od USING (queue)),
    z AS (SELECT r.*, r.qrank <= tg.quota AS in_quota FROM qr r JOIN tgt tg ON tg.session_id = r.session_id AND tg.queue = r.queue),
    p AS (SELECT session_id, item_id, queue, in_quota, row_number() OVER (PARTITION BY session_id ORDER BY in_quota DESC, CASE WHEN in_quota THEN qrank ELSE bo END, CASE WHEN in_quota THEN o ELSE qrank END, item_id) AS position FROM z)
    SELECT * FROM p WHERE position <= {CAP}""", _QV)
def rnk_quota_merge(t):
    sessions, queues = queue_inputs(t)
    persona = queues.where("queue = 'persona_similar'").select("session_id", F.lit(True).alias("has_persona")).distinct()
    flags = sessions.select("session_id", (F.size("preferred") > 0).alias("has_preferences")).join(persona, "session_id", "left").withColumn(
        "has_persona", F.coalesce("has_persona", F.lit(False)))
    return R.quota_merge(queues, R.queue_targets(flags, CAP), CAP).withColumn("position", F.col("position").cast("bigint"))


@query("rnk_interleave", """WITH a AS (SELECT retailer, item_id, 0 AS li, row_number() OVER (PARTITION BY retailer ORDER BY price_amount DESC, item_id) AS rk FROM items_b WHERE item_id % 2 = 0
      UNION ALL SELECT retailer, item_id, 1, row_number() OVER (PARTITION BY retailer ORDER BY item_id) FROM items_b WHERE item_id % 3 = 0)
    SELECT retailer, item_id, li AS list_index, position FROM (SELECT *, row_number() OVER (PARTITION BY retailer ORDER BY rk, li) AS position FROM a) WHERE position <= 30""", "items_b")
def rnk_interleave(t):
    i = t.items_b
    w = Window.partitionBy("retailer")
    a = i.where("item_id % 2 = 0").select("retailer", "item_id", F.lit(0).alias("list_index"), F.row_number().over(w.orderBy(F.desc("price_amount"), "item_id")).alias("rank"))
    b = i.where("item_id % 3 = 0").select("retailer", "item_id", F.lit(1).alias("list_index"), F.row_number().over(w.orderBy("item_id")).alias("rank"))
    both = a.where("rank <= 30").unionByName(b.where("rank <= 30"))
    return R.interleave(both, 30, "retailer").select("retailer", "item_id", "list_index", F.col("position").cast("bigint").alias("position"))


@query("rnk_spread", f"""WITH {topk_sql(30)}, x AS (SELECT t.session_id, t.item_id, t.rank, i.word2 AS k FROM top t JOIN items_b i USING (item_id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id, k ORDER BY rank) AS rn, count(*) OVER (PARTITION BY session_id, k) AS c, min(rank) OVER (PARTITION BY session_id, k) AS f FROM x)
    SELECT session_id, item_id, row_number() OVER (PARTITION BY session_id ORDER BY rn, c DESC, f) AS position FROM n""", _V)
def rnk_spread(t):
    rows = ranked(t, 30).join(t.items_b.select("item_id", "word2"), "item_id")
    return R.spread(rows, "word2").select("session_id", "item_id", F.col("position").cast("bigint").alias("position"))


@query("rnk_scene_defer", f"""WITH {topk_sql(40)}, x AS (SELECT t.*, CASE WHEN item_id % 3 = 1 THEN 1 ELSE 0 END AS cut FROM top t)
    SELECT session_id, item_id, cut = 1 AS recovered, position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cut, rank, item_id) AS position FROM x) WHERE position <= 30""", _V)
def rnk_scene_defer(t):
    rows = ranked(t, 40).withColumn("scene_type", F.expr("CASE item_id % 3 WHEN 0 THEN 'contextual' WHEN 1 THEN 'studio_cutout' END"))
    return R.scene_defer(rows, 30).select("session_id", "item_id", "recovered", F.col("position").cast("bigint").alias("position"))


@query("rnk_exploration", f"""WITH {topk_sql(40)}, p AS (SELECT *, rank <= 20 AS base FROM top),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id, base ORDER BY sha256('7:' || session_id || ':' || item_id)) AS pick, count(*) FILTER (WHERE base) OVER (PARTITION BY session_id) AS nb FROM p),
    c AS (SELECT *, floor(floor(0.12::DOUBLE * nb * 1e9 + 0.5) / 1e9) + CASE WHEN CAST('0x' || substr(sha256('7:' || session_id || ':draw'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < floor(0.12::DOUBLE * nb * 1e9 + 0.5) / 1e9 - floor(floor(0.12::DOUBLE * nb * 1e9 + 0.5) / 1e9) THEN 1 ELSE 0 END AS cnt FROM n),
    s AS (SELECT *, max(CASE WHEN base THEN rank END) OVER (PARTITION BY session_id, pick) AS slot, max(CASE WHEN NOT base THEN 1 END) OVER (PARTITION BY session_id, pick) AS has_new FROM c),
    z AS (SELECT *, pick <= cnt AND slot IS NOT NULL AND has_new IS NOT NULL AS sw FROM s)
    SELECT session_id, item_id, CASE WHEN base THEN rank ELSE slot END AS rank, NOT base AS explored FROM z WHERE CASE WHEN base THEN NOT sw ELSE sw END""", _V)
def rnk_exploration(t):
    out = R.explore(ranked(t, 40).select("session_id", "item_id", "rank"), F.lit(0.12), 20, seed=7)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("rnk_adaptive_rate", f"""WITH {WEIGHTS}, c AS (SELECT session_id, coalesce(CAST(max(weight) FILTER (WHERE weight > 0) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE weight > 0) AS DOUBLE), 0) AS conf FROM w GROUP BY 1)
    SELECT session_id, {sql_r4('greatest(0.04::DOUBLE, least(0.16::DOUBLE, 0.05::DOUBLE * (1.0::DOUBLE + (1.0::DOUBLE - conf) * 1.25::DOUBLE)))')} AS rate FROM c""", _V)
def rnk_adaptive_rate(t):
    return P.preference_confidence(weights(t)).select("session_id", r4(R.adaptive_rate(0.05, F.col("confidence"))).alias("rate"))


@query("rnk_variant_bucket", f"""SELECT o_custkey AS session_id, {sql_hash("CAST(o_custkey AS VARCHAR)")} % 100 AS bucket,
    CASE WHEN o_custkey % 2 = 0 THEN 'personal_plus_persona_multi_queue_persona' ELSE 'personal_only_multi_queue_personal' END || CASE WHEN o_custkey % 3 = 0 THEN '_exploration_8' ELSE '' END AS variant
    FROM (SELECT DISTINCT o_custkey FROM orders)""")
def rnk_variant_bucket(t):
    s = t.orders.select(F.col("o_custkey").alias("session_id")).distinct()
    return s.select("session_id", R.variant_bucket(F.col("session_id")).alias("bucket"),
                    R.variant_label(F.col("session_id") % 2 == 0, F.expr("IF(session_id % 3 = 0, 0.08D, 0D)")).alias("variant"))


_CAPPED = """, x AS (SELECT t.*, {key} AS k FROM top t JOIN items_b i USING (item_id)),
    a AS (SELECT *, row_number() OVER (PARTITION BY session_id, k ORDER BY rank) <= {cap} AS ok FROM x),
    b AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY session_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
    c AS (SELECT *, NOT ok AND before < {window} AS deferred FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id, deferred, k ORDER BY rank) AS rn, count(*) OVER (PARTITION BY session_id, deferred, k) AS cn, min(rank) OVER (PARTITION BY session_id, deferred, k) AS f FROM c)
    SELECT session_id, item_id, deferred, row_number() OVER (PARTITION BY session_id ORDER BY deferred, CASE WHEN deferred THEN rn ELSE rank END, CASE WHEN deferred THEN -cn END, CASE WHEN deferred THEN f END) AS position FROM n"""


@query("rnk_source_cap", f"WITH {topk_sql(60)}" + _CAPPED.format(key="i.source_id % 3", cap=6, window=15), _V)
def rnk_source_cap(t):
    rows = ranked(t, 60).join(t.items_b.selectExpr("item_id", "source_id % 3 AS source_key"), "item_id")
    return R.key_cap(rows, "source_key", 6, 15).select("session_id", "item_id", "deferred", F.col("position").cast("bigint").alias("position"))


@query("rnk_model_cap", f"WITH {topk_sql(60)}" + _CAPPED.format(key="i.model_key", cap=1, window=6), _V)
def rnk_model_cap(t):
    rows = ranked(t, 60).join(t.items_b.select("item_id", "model_key"), "item_id")
    return R.key_cap(rows, "model_key", 1, 6).select("session_id", "item_id", "deferred", F.col("position").cast("bigint").alias("position"))


@query("rnk_slate_metrics", f"""WITH {topk_sql(8)}, x AS (SELECT t.*, i.retailer || '::' || i.title AS fam, CAST(i.source_id % 4 AS VARCHAR) AS src,
      list_filter(['style:' || word2, 'style:' || type_tag, 'material:' || material, 'color:' || color_family], lambda z: z IS NOT NULL) AS tk FROM top t JOIN items_b i USING (item_id)),
    c AS (SELECT session_id, src, count(*) AS n FROM x GROUP BY 1, 2), pr AS (SELECT a.session_id, min(1.0::DOUBLE - len(list_intersect(a.tk, b.tk)) / len(list_distinct(list_concat(a.tk, b.tk)))) AS d
      FROM x a JOIN x b ON a.session_id = b.session_id AND a.rank < b.rank AND b.rank <= 4 GROUP BY 1)
    SELECT x.session_id, {sql_r4('(count(fam) - count(DISTINCT fam)) / count(fam)')} AS same_family_top8_rate, {sql_r4('(SELECT max(n) FROM c WHERE c.session_id = x.session_id) / count(*)')} AS source_concentration_top8,
      count(DISTINCT src) AS source_diversity_top8, {sql_r4('(SELECT d FROM pr WHERE pr.session_id = x.session_id)')} AS style_distance_top4_min FROM x GROUP BY x.session_id""", _V)
def rnk_slate_metrics(t):
    i = t.items_b
    attrs = i.select("item_id", F.concat(F.col("retailer").cast("string"), F.lit("::"), "title").alias("family_key"),
                     (F.col("source_id") % 4).alias("source_key"), R.style_tokens(i).alias("tokens"))
    return R.slate_metrics(ranked(t, 8).join(attrs, "item_id"))


_JAC = """SELECT i.item_id, j.item_id AS other_id, list_filter(['style:' || i.word2, 'style:' || i.type_tag, 'material:' || i.material, 'color:' || i.color_family], lambda z: z IS NOT NULL) AS a,
    list_filter(['style:' || j.word2, 'style:' || j.type_tag, 'material:' || j.material, 'color:' || j.color_family], lambda z: z IS NOT NULL) AS b FROM items_b i JOIN items_b j ON j.item_id = i.item_id + 1"""


@query("set_style_jaccard", f"""WITH p AS ({_JAC}) SELECT item_id, {sql_r4('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))')} AS similarity,
    {sql_r4('1.0::DOUBLE - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))')} AS distance FROM p""", "items_b")
def set_style_jaccard(t):
    tok = t.items_b.select("item_id", R.style_tokens(t.items_b).alias("a"))
    nxt = tok.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    sim = R.jaccard_similarity(F.col("a"), F.col("b"))
    return tok.join(nxt, "item_id").select("item_id", r4(sim).alias("similarity"), r4(1.0 - sim).alias("distance"))


_NOISE = ", ".join(f"'{w}'" for w in R.TITLE_COLORS + R.TITLE_NOISE)
_WORDS = r"list_filter(string_split(trim(regexp_replace(translate(lower(title), 'åäöéè', 'aaoee'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\d+$'))"


@query("set_model_keys", f"""WITH w AS (SELECT item_id, source_id, {_WORDS} AS ws FROM catalog_b),
    f AS (SELECT *, list_filter(ws, lambda x: x NOT IN ({_NOISE})) AS inf FROM w),
    u AS (SELECT *, list_sort(list_filter(inf, lambda x, i: list_position(inf, x) = i)[1:2]) AS k FROM f)
    SELECT item_id, array_to_string(k, '_') AS model_key, source_id || '::' || array_to_string(k, '_') AS family_key FROM u""", "catalog_b")
def set_model_keys(t):
    items = t.catalog_b.withColumn("retailer", F.col("source_id"))
    return R.with_item_keys(items).select("item_id", "model_key", "family_key")


# ---- evaluation ---------------------------------------------------------------------------------------

_SHARE = """srv AS (SELECT DISTINCT session_id, item_id FROM responses_b WHERE position <= 3),
    sh AS (SELECT l.session_id, count(*) AS liked, count(s.item_id) AS covered FROM likes_b l LEFT JOIN srv s ON s.session_id = l.session_id AND s.item_id = l.item_id GROUP BY 1)"""


def _r6(c: str) -> str:
    return f"floor(({c}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


@query("evl_liked_in_topk", f"WITH {_SHARE} SELECT count(*) AS sessions, {_r6('avg(covered / liked)')} AS liked_in_topk FROM sh", "responses_b likes_b")
def evl_liked_in_topk(t):
    return E.liked_in_topk(t.responses_b, t.likes_b, 3)


@query("evl_by_variant", f"""WITH {_SHARE}, v AS (SELECT session_id, arg_min(variant, struct_pack(a := ts, b := request_id)) AS variant FROM responses_b GROUP BY 1),
    g AS (SELECT variant, count(*) AS sessions, avg(covered / liked) AS m, coalesce(stddev_samp(covered / liked), 0) * 1.96 / sqrt(count(*)) AS h FROM sh JOIN v USING (session_id) GROUP BY 1)
    SELECT variant, sessions, {_r6('m')} AS liked_in_topk, {_r6('m - h')} AS ci_low, {_r6('m + h')} AS ci_high FROM g""", "responses_b likes_b")
def evl_by_variant(t):
    return E.by_variant(t.responses_b, t.likes_b, t.responses_b.select("session_id", "request_id", "ts", "variant"), 3)


@query("evl_oracle_topk", f"""WITH {WEIGHTS}, o AS (SELECT w.session_id, f.item_id, CAST(sum(weight) AS DOUBLE) AS score FROM w JOIN feat f USING (key) JOIN items_b i ON i.item_id = f.item_id AND i.is_active
      WHERE weight <> 0 AND (NOT contains(f.key, ':') OR regexp_matches(f.key, '^(material|color|size):')) GROUP BY ALL HAVING sum(weight) > 0)
    SELECT session_id, item_id, {sql_r4('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item_id) AS rank FROM o) WHERE rank <= 20""", _V)
def evl_oracle_topk(t):
    return E.oracle_topk(weights(t), t.items_b, 20).select("session_id", "item_id", r4(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_SITE = """pg AS (SELECT page_id, host AS site, page_id % 3 <> 0 AS accepted, page_id % 3 <> 0 AND page_id % 4 <> 0 AS complete, page_id % 5 AS image_urls, (page_id % 5) // 2 AS valid_images,
    CASE page_id % 9 WHEN 0 THEN 'HTTP 403 Forbidden' WHEN 3 THEN 'read timeout' WHEN 6 THEN 'blocked by robots' END AS error FROM pages_b)"""


def site_pages(t):
    return t.pages_b.selectExpr("page_id", "host AS site", "page_id % 3 <> 0 AS accepted", "page_id % 3 <> 0 AND page_id % 4 <> 0 AS complete",
                                "page_id % 5 AS image_urls", "(page_id % 5) div 2 AS valid_images",
                                "CASE page_id % 9 WHEN 0 THEN 'HTTP 403 Forbidden' WHEN 3 THEN 'read timeout' WHEN 6 THEN 'blocked by robots' END AS error")


@query("evl_crawl_sites", f"""WITH {_SITE}, g AS (SELECT coalesce(site, 'TOTAL') AS site, count(*) AS pages, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE complete) AS complete,
      sum(image_urls) AS iu, sum(valid_images) AS vi FROM pg GROUP BY ROLLUP (site))
    SELECT site, pages, accepted, complete, {sql_r4('accepted / pages')} AS completion, {sql_r4('CASE WHEN iu > 0 THEN vi / iu ELSE 0 END')} AS image_validity,
      CASE WHEN site = 'TOTAL' THEN (SELECT count(*) FROM pg WHERE error LIKE '%403%') ELSE 0 END AS blocked_403 FROM g""", "pages_b")
def evl_crawl_sites(t):
    pages = site_pages(t)
    fails = E.failure_reasons(pages, error_label(F.col("error")))
    blocked = fails.where("reason = 'http-403'").agg(F.coalesce(F.sum("pages"), F.lit(0))).scalar()
    return E.crawl_eval(pages).withColumn("blocked_403", F.when(F.col("site") == "TOTAL", blocked).otherwise(F.lit(0)))


@query("evl_readiness", f"""WITH {_SITE}, h AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rn FROM pg)
    SELECT site, count(*) AS sampled, count(*) FILTER (WHERE accepted) AS accepted, CASE WHEN count(*) FILTER (WHERE accepted) / count(*) >= 0.75 THEN 'ready'
      WHEN count(*) FILTER (WHERE accepted) > 0 THEN 'partial' ELSE 'blocked' END AS label FROM h WHERE rn <= 8 GROUP BY site""", "pages_b")
def evl_readiness(t):
    return E.readiness(site_pages(t))


@query("evl_recipe_gate", f"""WITH r AS (SELECT 'recipe_' || host AS recipe, page_id % 10 <> 3 AS ok, CASE WHEN page_id % 4 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS c FROM pages_b),
    g AS (SELECT recipe, count(*) AS pages, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS hard_failures, count(*) FILTER (WHERE ok) / count(*) AS sr,
      CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN sum(c) FILTER (WHERE ok) / count(*) FILTER (WHERE ok) ELSE 0 END AS ac FROM r GROUP BY 1)
    SELECT recipe, pages, succeeded, hard_failures, {sql_r4('sr')} AS success_rate, {sql_r4('ac')} AS avg_completeness, sr >= 0.85 AND floor(ac * 1e9 + 0.5) / 1e9 >= 0.75 AND hard_failures = 0 AS passes FROM g""", "pages_b")
def evl_recipe_gate(t):
    return recipe_gate(t.pages_b.selectExpr("concat('recipe_', host) AS recipe", "page_id % 10 <> 3 AS ok", "IF(page_id % 4 = 0, 0.5D, 0.9D) AS completeness"))
