"""Slate shaping and deck queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import campaigns as C
from larkspur.operators import evaluate as E
from larkspur.operators import filters as _G
from larkspur.operators import preferences as P
from larkspur.operators import ranking as R
from larkspur.operators import shaping as S
from larkspur.operators import targeting as T
from larkspur.plans import decks as D
from larkspur.plans import slate_sql as Q
from larkspur.plans.q_campaigns import _MATCH, profiles, segments
from larkspur.plans.q_joins import as_of
from larkspur.plans.q_preferences import _PRIORS, BOUNDS, PERSONA, PV, WEIGHTS, personas, weights
from larkspur.plans.q_preferences import profiles as onboarding
from larkspur.plans.q_quality import r4, sql_r4
from larkspur.plans.q_ranking import ranked, topk_sql
from larkspur.plans.registry import query
from larkspur.session import materialize

_V = "items_b swipes_b"
_NOISE = ", ".join(f"'{w}'" for w in R.TITLE_COLORS + R.TITLE_NOISE)
_WORDS = rf"list_filter(string_split(lower(title), ' '), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\d+$') AND x NOT IN ({_NOISE}))"


def _at(table: str, tokens: str, url: str, seat: str) -> str:
    return f"""keyed AS (SELECT *, array_to_string(list_sort({_WORDS}[1:2]), '_') AS mod FROM {table}),
  attr AS MATERIALIZED (SELECT item_id, retailer || '::' || mod AS fam, mod, mod || '::' || coalesce(color_family, 'unknown') || '::' || coalesce({seat}, 'unknown') AS var, CAST(source_id AS VARCHAR) AS src,
    coalesce(creative_score >= 60, image_count >= 2) AS ok, list_filter([{tokens}], lambda z: z IS NOT NULL) AS tk, CAST(retailer AS VARCHAR) AS ret, {url} AS url FROM keyed)"""


_STYLE = "'style:' || word2, 'style:' || type_tag, 'material:' || material, 'color:' || color_family"
_SLATE_AT = _at("items_b", _STYLE, "'https://shop.example/' || title || '/' || (item_id % 400)", "NULL")
_SIXTY = f"top60 AS (SELECT session_id, rank, item_id, score, 0 AS queue FROM top), {_SLATE_AT}"
_DONE = "SELECT session_id, rank AS position, item_id, {r4} AS score FROM {name}"


def _rule_sql(name: str, rule: str, at: str = _SIXTY, k: int = 60) -> str:
    return f"WITH RECURSIVE {topk_sql(k)}, {at},\n  {rule} " + _DONE.format(r4=sql_r4("score"), name=name)


def _slates(t, k: int = 60):
    attrs = R.with_item_keys(t.items_b)
    attrs = attrs.select("item_id", "model_key", "family_key", "variant_key", F.col("source_id").cast("string").alias("source_key"),
                         F.coalesce(F.col("creative_score") >= 60, F.col("image_count") >= 2).alias("quality_ok"), R.style_tokens(t.items_b).alias("tokens"),
                         F.col("retailer").cast("string").alias("retailer"), (F.col("item_id") % 5 == 0).alias("featured"),
                         F.concat(F.lit("https://shop.example/"), "title", F.lit("/"), (F.col("item_id") % 400).cast("string")).alias("canonical_url"))
    return S.slate_rows(ranked(t, k).join(attrs, "item_id"))


def _shown(slates):
    return S.unpack(slates).select("session_id", F.col("position").cast("bigint").alias("position"), "item_id", r4(F.col("score")).alias("score"))


_MMR_AT = _SIXTY.replace(_STYLE, _STYLE + ", 'size:' || size_class")


@query("rnk_mmr", _rule_sql("z", Q.mmr("z", "top60", 0.7, 40), _MMR_AT), _V)
def rnk_mmr(t):
    tokens = t.items_b.select("item_id", R.style_tokens(t.items_b, R.MMR_FAMILIES).alias("tokens"))
    return _shown(S.reorder(S.slate_rows(ranked(t, 60).join(tokens, "item_id")), lambda r: S.mmr(r, 0.7, 40)))


@query("rnk_near_duplicates", _rule_sql("z", Q.near("z", "top60", S.ShapeOptions())), _V)
def rnk_near_duplicates(t):
    return _shown(S.reorder(_slates(t), lambda r: S.near_duplicates(r, S.ShapeOptions())))


@query("rnk_featured_slots", _rule_sql("z", Q.featured("z", "top60", "r.item_id % 5 = 0", 20, "5", 2)), _V)
def rnk_featured_slots(t):
    return _shown(S.reorder(_slates(t), lambda r: S.featured_slots(r, 20, 5, 2)))


@query("rnk_accept_dedupe", _rule_sql("z", Q.accept("z", "top60", 40, 12, 4, 0.4)), _V)
def rnk_accept_dedupe(t):
    return _shown(S.reorder(_slates(t), lambda r: S.accept(r, 40, min_distance=0.4)))


@query("rnk_pool_normalized", f"""WITH {topk_sql(60)}, x AS (SELECT *, min(score) OVER (PARTITION BY session_id) AS lo, max(score) OVER (PARTITION BY session_id) AS hi FROM top)
    SELECT session_id, item_id, {sql_r4('CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END')} AS relevance FROM x""", _V)
def rnk_pool_normalized(t):
    return R.pool_normalized(ranked(t, 60)).select("session_id", "item_id", r4(F.col("relevance")).alias("relevance"))


# ---- the deck -----------------------------------------------------------------------------------------------

OPTIONS = D.DeckOptions()
COLD = 24  # sessions with fewer swipes take onboarding picks and priors as well


def offered(t):
    n = t.supplier.agg(F.count("*")).scalar()
    promoted = t.items_b.where("item_id % 3 = 0").select("item_id", F.when(F.col("item_id") % 4 != 0, 1 + F.col("item_id") % n).alias("campaign_id"))
    products = t.lineitem.select(F.col("l_suppkey").alias("campaign_id"), F.col("l_partkey").alias("item_id"))
    return D.offers(promoted, t.campaigns_b.where("status = 'active'"), products)


def slates(t):
    picks = P.pick_weights(P.pick_attributes(t.picks_b, t.items_b))
    counts = t.swipes_b.groupBy("session_id").agg(F.count("*").alias("n_swipes"))
    wanted = lambda df: df.join(t.deck_sessions_b.select("session_id"), "session_id", "left_semi")
    merged = P.merge_weights(weights(t), wanted(picks), wanted(P.onboarding_weights(onboarding(t))), counts, limited=COLD)
    running = t.campaigns_b.where("status = 'active'")
    matches = lambda asked: T.match_segments(wanted(profiles(t)), segments(t).join(asked, "segment_id", "left_semi"))
    every = C.frequency_cap(running).scalar().cast("int")
    return D.build_slates(t.deck_sessions_b, materialize(merged, "deck_weights"), t.deck_items_b, offered(t), t.swipes_b, personas(t), matches, as_of(t), every, BOUNDS, OPTIONS, materialize)


_KEYS = """dfeat AS (SELECT item_id, unnest(list_filter([word2, type_tag, 'material:' || material, 'color:' || color_family, 'size:' || size_class, 'brand:' || lower(brand), 'seat_bucket:' || seat_bucket,
      'subcat:' || sub_category, CASE WHEN small_space THEN 'feature:small_space' END, CASE WHEN modular THEN 'feature:modular' END,
      'price_bucket:' || CASE WHEN price_amount <= 920 THEN 'budget' WHEN price_amount <= 940 THEN 'affordable' WHEN price_amount <= 960 THEN 'mid' WHEN price_amount <= 980 THEN 'premium' ELSE 'luxury' END,
      'seats:' || seat_count], lambda z: z IS NOT NULL)) AS key FROM deck_items_b)"""
_TITLE = lambda words: " OR ".join(f"contains(lower(title), '{w}')" for w in words)
_ITEMS = f"""di AS MATERIALIZED (SELECT *, coalesce(canonical_url, 'item:' || item_id) AS ukey,
      CASE WHEN ({_TITLE(_G.SURFACE_NOISE)}) OR coalesce(decision = 'REJECT', false) THEN false WHEN coalesce(decision = 'ACCEPT', false) THEN true WHEN coalesce(category = 'sofa', false) THEN true
        ELSE ({_TITLE(_G.SURFACE_TITLE)}) END AS surf
    FROM deck_items_b WHERE is_active AND coalesce(catalog_included, true) AND image_count > 0 AND NOT coalesce(issues = ['No-Valid-Images'], false) AND NOT (images_validated AND valid_image_count <= 0)),
  {_at('deck_items_b', _STYLE + ", 'seat_bucket:' || seat_bucket, 'subcat:' || sub_category, CASE WHEN modular THEN 'feature:modular' END, CASE WHEN small_space THEN 'feature:small_space' END", "canonical_url", "seat_bucket")}"""
_MERGED = f"""few AS (SELECT session_id FROM swipes_b GROUP BY 1 HAVING count(*) >= {COLD}),
  h AS (SELECT session_id, unnest(picked[1:3]) AS item_id FROM picks_b WHERE session_id IN (SELECT session_id FROM deck_sessions_b)),
  pk AS (SELECT DISTINCT session_id, key FROM h JOIN feat USING (item_id) WHERE key NOT LIKE 'brand:%' AND key NOT LIKE 'size:%' AND key NOT LIKE 'price_bucket:%' AND key NOT LIKE 'seats:%'),
  mu AS (SELECT session_id, key, weight, 0 AS r FROM w UNION ALL SELECT session_id, key, 3.00, 1 FROM pk WHERE session_id NOT IN (SELECT session_id FROM few)
    UNION ALL SELECT session_id, key, weight, 2 FROM pri WHERE session_id NOT IN (SELECT session_id FROM few) AND session_id IN (SELECT session_id FROM deck_sessions_b)),
  mw AS MATERIALIZED (SELECT session_id, key, arg_min(weight, r)::DECIMAL(12,2) AS weight FROM mu GROUP BY 1, 2)"""
_OFFERS = """run AS (SELECT * FROM campaigns_b WHERE status = 'active'), ps AS (SELECT DISTINCT l_suppkey AS campaign_id, l_partkey AS item_id FROM lineitem),
  pr0 AS (SELECT item_id, CASE WHEN item_id % 4 <> 0 THEN 1 + item_id % (SELECT count(*) FROM supplier) END AS campaign_id FROM items_b WHERE item_id % 3 = 0),
  off AS MATERIALIZED (SELECT p.item_id, p.campaign_id, c.segment_id FROM pr0 p LEFT JOIN run c USING (campaign_id)
    WHERE p.campaign_id IS NULL OR (c.segment_id IS NOT NULL AND (NOT (c.product_mode IN ('selected', 'auto') AND c.campaign_id IN (SELECT campaign_id FROM ps)) OR EXISTS (SELECT 1 FROM ps WHERE ps.campaign_id = p.campaign_id AND ps.item_id = p.item_id))))"""
_POOL = f"""lst AS (SELECT item_id, 0 AS li, row_number() OVER (ORDER BY updated_day DESC, item_id DESC) AS rk FROM di WHERE item_id IN (SELECT item_id FROM off)
      UNION ALL SELECT item_id, 1, row_number() OVER (ORDER BY updated_day DESC, item_id DESC) FROM di),
  one AS (SELECT item_id, min(rk * 2 + li) AS o, min(rk) FILTER (WHERE li = 0) AS pr, min(rk) FILTER (WHERE li = 1) AS cr FROM lst WHERE rk <= {OPTIONS.pool} GROUP BY item_id),
  pool AS MATERIALIZED (SELECT item_id, pr, cr, CASE WHEN pos <= {OPTIONS.pool} THEN pos END AS pos FROM (SELECT *, row_number() OVER (ORDER BY o) AS pos FROM one))"""
_FACTS = f"""t14 AS (SELECT session_id, key FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, key) AS r FROM mw WHERE weight > 0) WHERE r <= 14),
  cf AS (SELECT session_id, coalesce(CAST(max(weight) FILTER (WHERE weight > 0) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE weight > 0) AS DOUBLE), 0) AS conf FROM mw GROUP BY 1),
  ns AS (SELECT session_id, count(*) AS n_swipes FROM swipes_b GROUP BY 1),
  sn AS (SELECT DISTINCT session_id, item_id FROM swipes_b WHERE ts >= (SELECT max(ts) FROM interactions_b) - INTERVAL {OPTIONS.recycle_days} DAY),
  ch AS MATERIALIZED (SELECT s.session_id, p.item_id, p.rank, p.normalized_score FROM deck_sessions_b s JOIN per p USING (pick_hash) JOIN di USING (item_id) WHERE p.rank <= {OPTIONS.cohort_items}),
  se AS MATERIALIZED (SELECT s.*, coalesce(n.n_swipes, 0) AS sw, coalesce(c.conf, 0) AS conf, s.session_id IN (SELECT session_id FROM t14) AS hp, s.session_id IN (SELECT session_id FROM ch) AS hc,
      s.session_id IN (SELECT session_id FROM mw WHERE weight <> 0) AS hw FROM deck_sessions_b s LEFT JOIN ns n USING (session_id) LEFT JOIN cf c USING (session_id)),
  rates AS (SELECT session_id, greatest(0.04::DOUBLE, least(0.16::DOUBLE, {OPTIONS.exploration}::DOUBLE * (1.0::DOUBLE + (1.0::DOUBLE - conf) * 1.25::DOUBLE))) AS rate FROM se),
  ok AS MATERIALIZED (SELECT s.session_id, i.item_id FROM se s JOIN di i ON (s.want_size_class IS NULL OR coalesce(i.size_class = s.want_size_class, false)) AND (s.want_color_family IS NULL OR coalesce(i.color_family = s.want_color_family, false))
      AND (s.sw < {_G.MEDIUM_SWIPES} OR ((s.want_seat_bucket IS NULL OR CASE WHEN i.seat_bucket IS NOT NULL THEN i.seat_bucket = s.want_seat_bucket ELSE coalesce((s.want_seat_bucket = '2' AND i.sub_category = '2_seater') OR (s.want_seat_bucket = '3' AND i.sub_category = '3_seater'), false) END)
        AND (NOT s.modular_only OR i.modular) AND (NOT s.want_small_space OR i.small_space)
        AND (s.sw < {_G.HARD_SWIPES} OR ((s.budget_min IS NULL OR i.price_amount >= s.budget_min) AND (s.budget_max IS NULL OR i.price_amount <= s.budget_max)))))
      WHERE i.item_id IN (SELECT item_id FROM pool UNION ALL SELECT item_id FROM ch))"""
_HASH = ("abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({e}, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: "
         "CASE WHEN ((a * 31 + x) & 4294967295) >= 2147483648 THEN ((a * 31 + x) & 4294967295) - 4294967296 ELSE ((a * 31 + x) & 4294967295) END))")
_LISTS = f"""ov AS (SELECT p.session_id, f.item_id, sum(CASE WHEN key LIKE 'material:%' OR key LIKE 'color:%' OR NOT contains(key, ':') THEN 2
      WHEN regexp_matches(key, '^(size|brand|delivery|condition|eco|feature|price_bucket):') THEN 1 ELSE 0 END) AS overlap FROM t14 p JOIN dfeat f USING (key) WHERE f.item_id IN (SELECT item_id FROM pool) GROUP BY 1, 2),
  en AS MATERIALIZED (SELECT k.session_id, p.*, i.surf, coalesce(o.overlap, 0) AS overlap, f.item_id IS NOT NULL AS offered, f.campaign_id IS NULL OR EXISTS (SELECT 1 FROM mt WHERE mt.match_score >= 0.5 AND mt.session_id = k.session_id AND mt.segment_id = f.segment_id) AS fits
    FROM ok k JOIN pool p USING (item_id) JOIN di i USING (item_id) LEFT JOIN ov o ON o.session_id = k.session_id AND o.item_id = p.item_id LEFT JOIN off f ON f.item_id = p.item_id),
  qr AS MATERIALIZED (SELECT session_id, 0 AS q, row_number() OVER (PARTITION BY session_id ORDER BY overlap DESC, pos) AS o, item_id FROM en WHERE surf AND pos IS NOT NULL AND overlap > 0
    UNION ALL SELECT c.session_id, 1, c.rank, c.item_id FROM ch c JOIN ok USING (session_id, item_id) JOIN di USING (item_id) WHERE surf
    UNION ALL SELECT session_id, 2, pr, item_id FROM en WHERE pr IS NOT NULL AND offered AND fits
    UNION ALL SELECT session_id, 3, cr, item_id FROM en WHERE surf AND cr IS NOT NULL
    UNION ALL SELECT session_id, 4, pos, item_id FROM en WHERE surf AND pos > floor((SELECT count(pos) FROM pool) * {R.LONG_TAIL_START}::DOUBLE)
    UNION ALL SELECT session_id, 5, row_number() OVER (PARTITION BY session_id ORDER BY {_HASH.format(e="session_id || ':' || item_id")}, pos), item_id FROM en WHERE surf AND pos IS NOT NULL AND overlap = 0),
  fr AS (SELECT q.*, s.item_id IS NULL AS fresh FROM qr q LEFT JOIN sn s ON s.session_id = q.session_id AND s.item_id = q.item_id),
  ag AS (SELECT s.session_id, NOT coalesce(bool_or(fresh), false) AS again FROM se s LEFT JOIN fr USING (session_id) GROUP BY 1),
  ls AS (SELECT f.session_id, CASE WHEN NOT again AND i.scene_type = 'studio_cutout' THEN f.q + 6 ELSE f.q END AS q,
      list(struct_pack(item_id := f.item_id, ukey := i.ukey, fam := a.fam, mod := a.mod, tk := a.tk) ORDER BY f.o) AS rows
    FROM fr f JOIN ag USING (session_id) JOIN di i USING (item_id) JOIN attr a USING (item_id) WHERE again OR fresh GROUP BY 1, 2)"""


def _codes(quotas: bool) -> str:
    backfill = [R.QUEUE_ORDER.index(q) for q in R.BACKFILL_ORDER] if quotas else range(6)
    rounds = max(max(R.queue_quota(OPTIONS.cap, p, s).values()) for p in (True, False) for s in (True, False)) if quotas else 0
    one = lambda q: [q * 4] * OPTIONS.head + [q * 4 + 2]
    codes = [q * 4 + 1 for _ in range(rounds) for q in range(6)] + [c for q in backfill for c in one(q)] + [c for q in backfill for c in one(q + 6)]
    return f"[{', '.join(map(str, codes))}]"


_QUOTA = "CASE " + " ".join(f"WHEN hp = {str(p).lower()} AND hc = {str(c).lower()} THEN [{', '.join(str(R.queue_quota(OPTIONS.cap, p, c)[q]) for q in R.QUEUE_ORDER)}]" for p in (True, False) for c in (True, False)) + " END"
_L = "ql[q + 1]"
_SEEN = lambda c: f"coalesce(list_contains(list_transform(taken[1:{OPTIONS.head}], lambda x: x.r.{c}), {_L}[i].{c}), false)"
_NEAR = f"coalesce({Q.closest(f'{_L}[i].tk', 'tr', 'range(1, len(tr) + 1)')} < {OPTIONS.first_distance}, false)"
_ACCEPT = f"""mv AS MATERIALIZED (SELECT s.session_id, s.onboarded, {_QUOTA} AS quota, CASE WHEN again THEN {_codes(False)} ELSE {_codes(True)} END AS codes,
      list_transform(range(0, 12), lambda j: coalesce(list_filter(g.gs, lambda x: x.q = j)[1].rows, [])) AS ql
    FROM se s JOIN ag USING (session_id) LEFT JOIN (SELECT session_id, list(struct_pack(q := q, rows := rows)) AS gs FROM ls GROUP BY 1) g USING (session_id)),
  ac AS (SELECT session_id, 0 AS m, []::STRUCT(q INT, r STRUCT(item_id BIGINT, ukey VARCHAR, fam VARCHAR, mod VARCHAR, tk VARCHAR[]))[] AS taken, list_transform(range(0, 12), lambda j: 0) AS cur, list_transform(range(0, 6), lambda j: 0) AS used FROM mv
    UNION ALL SELECT session_id, m + 1, list_concat(taken, list_transform(cand, lambda i: struct_pack(q := (q % 6)::INT, r := {_L}[i]))),
      list_transform(range(1, 13), lambda j: CASE WHEN j = q + 1 AND NOT idle THEN (CASE WHEN len(cand) = 0 OR whole THEN len({_L}) ELSE cand[1] END)::INT ELSE cur[j] END),
      list_transform(range(1, 7), lambda j: CASE WHEN j = q % 6 + 1 THEN used[j] + len(cand)::INT ELSE used[j] END)
    FROM (SELECT *, CASE WHEN idle THEN [] WHEN len(taken) < {OPTIONS.head} THEN CASE WHEN whole THEN [] ELSE list_filter(range(cur0 + 1, len({_L}) + 1), lambda i: NOT list_contains(uk, {_L}[i].ukey) AND NOT {_SEEN('fam')} AND NOT {_SEEN('mod')}
          AND NOT (onboarded AND len(taken) < {OPTIONS.first} AND {_NEAR}))[1:1] END
        ELSE list_filter(range(cur0 + 1, len({_L}) + 1), lambda i: NOT list_contains(uk, {_L}[i].ukey) AND list_position(rest, {_L}[i].ukey) = i - cur0)[1:CASE WHEN whole THEN greatest(0, {OPTIONS.cap} - len(taken)) ELSE 1 END] END AS cand
      FROM (SELECT *, list_transform(taken, lambda x: x.r.ukey) AS uk, list_transform(taken, lambda x: x.r) AS tr, list_transform({_L}[cur0 + 1:], lambda x: x.ukey) AS rest,
          len(taken) >= {OPTIONS.cap} OR cur0 >= len({_L}) OR (counted AND used[q % 6 + 1] >= quota[q % 6 + 1]) AS idle
        FROM (SELECT a.*, v.ql, v.quota, v.onboarded, v.codes[a.m + 1] // 4 AS q, v.codes[a.m + 1] % 2 = 1 AS counted, v.codes[a.m + 1] // 2 % 2 = 1 AS whole, a.cur[v.codes[a.m + 1] // 4 + 1] AS cur0
          FROM ac a JOIN mv v USING (session_id) WHERE a.m < len(v.codes))))),
  cd AS MATERIALIZED (SELECT session_id, x.q AS queue, x.r.item_id AS item_id FROM (SELECT a.session_id, unnest(a.taken) AS x FROM ac a JOIN mv v USING (session_id) WHERE a.m = len(v.codes)))"""
_RANK = f"""sgs AS (SELECT c.session_id, c.item_id, CAST(sum(w.weight) AS DOUBLE) / sqrt(CAST(count(*) AS DOUBLE)) AS own, count(*) AS signals FROM cd c JOIN dfeat f USING (item_id) JOIN mw w ON w.session_id = c.session_id AND w.key = f.key WHERE w.weight <> 0 GROUP BY 1, 2),
  sc AS (SELECT c.*, coalesce(g.own, 0.0::DOUBLE) AS own, coalesce(g.signals, 0) AS signals, coalesce(h.normalized_score, 0.0::DOUBLE) AS ps FROM cd c LEFT JOIN sgs g ON g.session_id = c.session_id AND g.item_id = c.item_id LEFT JOIN ch h ON h.session_id = c.session_id AND h.item_id = c.item_id),
  sm AS (SELECT *, max(ps) OVER (PARTITION BY session_id) AS mx FROM sc),
  sa AS (SELECT m.*, CASE WHEN NOT e.hw THEN 0.0::DOUBLE WHEN signals = 0 THEN {OPTIONS.cold_alpha}::DOUBLE ELSE {OPTIONS.alpha}::DOUBLE END AS a FROM sm m JOIN se e USING (session_id)),
  sf AS (SELECT session_id, item_id, queue, CASE WHEN mx > 0 THEN floor((a * own + (1.0::DOUBLE - a) * (ps / mx)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE ELSE own END AS score FROM sa),
  r0 AS MATERIALIZED (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item_id) AS rank, item_id, score, queue FROM sf)"""
_EVERY = "(SELECT CAST(greatest(2, least(12, min(coalesce(frequency_cap, 12)))) AS BIGINT) FROM run)"
DECK_SQL = f"""WITH RECURSIVE {WEIGHTS}, {_PRIORS}, {PERSONA}, {_MATCH}, {_KEYS}, {_ITEMS}, {_MERGED}, {_OFFERS}, {_POOL}, {_FACTS},
  {_LISTS}, {_ACCEPT}, {_RANK},
  {Q.mmr('r1', 'r0', OPTIONS.mmr_lambda, OPTIONS.mmr_top)},
  {Q.explore('r2', 'r1', 'rates', OPTIONS.limit, OPTIONS.seed)},
  {Q.shape('dk', 'r2', 'r.queue = 2', _EVERY, OPTIONS.shape)}"""
_DV = PV + " items_b deck_items_b deck_sessions_b onboarding_b picks_b profiles_b segments_b campaigns_b"
_QUEUE = "[" + ", ".join(f"'{q}'" for q in R.QUEUE_ORDER) + "]"


@query("rnk_build_decks", f"{DECK_SQL} SELECT session_id, rank AS position, item_id, {sql_r4('score')} AS score, {_QUEUE}[queue + 1] AS queue, queue = 2 AS featured FROM dk", _DV)
def rnk_build_decks(t):
    return D.deck_rows(slates(t)).select("session_id", F.col("position").cast("bigint").alias("position"), "item_id", r4(F.col("score")).alias("score"), "queue", "featured")


@query("rnk_deck_facts", f"""{DECK_SQL}, dx AS (SELECT d.session_id, d.rank, a.* FROM dk d JOIN attr a USING (item_id) WHERE d.rank <= 8),
    dc AS (SELECT session_id, src, count(*) AS n FROM dx GROUP BY 1, 2),
    dp AS (SELECT a.session_id, min(1.0::DOUBLE - {Q.jaccard('a.tk', 'b.tk')}) AS d FROM dx a JOIN dx b ON a.session_id = b.session_id AND a.rank < b.rank AND b.rank <= 4 WHERE len(a.tk) >= 2 AND len(b.tk) >= 2 GROUP BY 1),
    dg AS (SELECT session_id, count(*) AS n, count(fam) AS f, count(DISTINCT fam) AS df, count(DISTINCT src) AS ds FROM dx GROUP BY 1)
    SELECT s.session_id, CASE WHEN dg.n IS NULL THEN 'catalog_exhausted' WHEN ag.again THEN 'recycled_seen_items' ELSE 'none' END AS fallback,
      CASE WHEN s.hc THEN 'personal_plus_persona_multi_queue_persona' ELSE 'personal_only_multi_queue_personal' END || '_exploration_' || CAST(floor(rates.rate * 100.0::DOUBLE + 0.5) AS BIGINT) AS variant,
      {sql_r4('coalesce((dg.f - dg.df) / dg.f, 0)')} AS same_family_top8_rate, {sql_r4('coalesce((SELECT max(n) FROM dc WHERE dc.session_id = s.session_id) / dg.n, 0)')} AS source_concentration_top8,
      coalesce(dg.ds, 0) AS source_diversity_top8, {sql_r4('dp.d')} AS style_distance_top4_min
    FROM se s JOIN ag USING (session_id) JOIN rates USING (session_id) LEFT JOIN dg USING (session_id) LEFT JOIN dp USING (session_id)""", _DV)
def rnk_deck_facts(t):
    return slates(t).select("session_id", "fallback", "variant", "facts.*")


# ---- offline study ------------------------------------------------------------------------------------------

_R6 = "floor(({}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"
_STUDY = f"""WITH RECURSIVE {topk_sql(80)}, {_MMR_AT.replace("top60 AS", "t80 AS")},
  {Q.mmr('m80', 't80', 0.95, 80)},
  cfd AS (SELECT session_id, coalesce(CAST(max(weight) FILTER (WHERE weight > 0) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE weight > 0) AS DOUBLE), 0) AS conf FROM w GROUP BY 1),
  flat AS (SELECT session_id, 0.08::DOUBLE AS rate FROM cfd),
  adapt AS (SELECT session_id, greatest(0.04::DOUBLE, least(0.16::DOUBLE, 0.08::DOUBLE * (1.0::DOUBLE + (1.0::DOUBLE - conf) * 1.25::DOUBLE))) AS rate FROM cfd),
  {Q.explore('e0', 't80', 'flat', 20, 3)},
  {Q.explore('e1', 'm80', 'flat', 20, 3)},
  {Q.explore('e2', 'm80', 'adapt', 20, 3)},
  sl AS MATERIALIZED (SELECT 'baseline' AS variant, session_id, rank, item_id FROM e0 UNION ALL SELECT 'mmr', session_id, rank, item_id FROM e1 UNION ALL SELECT 'mmr_adaptive', session_id, rank, item_id FROM e2),
  orc AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item_id) AS r FROM pair WHERE score > 0) WHERE r <= 20),
  osz AS (SELECT session_id, count(*) AS n FROM orc GROUP BY 1),
  per1 AS (SELECT s.variant, s.session_id, count(o.item_id) AS covered, avg(coalesce(o.score, 0.0::DOUBLE)) AS relevance FROM sl s LEFT JOIN orc o ON o.session_id = s.session_id AND o.item_id = s.item_id GROUP BY 1, 2),
  dv AS (SELECT a.variant, a.session_id, sum({Q.jaccard('x.tk', 'y.tk')}) AS total, count(*) AS n FROM sl a JOIN sl b ON a.variant = b.variant AND a.session_id = b.session_id AND a.rank < b.rank
    JOIN attr x ON x.item_id = a.item_id JOIN attr y ON y.item_id = b.item_id GROUP BY 1, 2)
  SELECT p.variant, count(*) AS sessions, {_R6.format('avg(p.covered / z.n)')} AS coverage, {_R6.format('avg(p.relevance)')} AS relevance, {_R6.format('avg(1.0::DOUBLE - coalesce(d.total / d.n, 0))')} AS diversity
  FROM per1 p JOIN osz z USING (session_id) LEFT JOIN dv d ON d.variant = p.variant AND d.session_id = p.session_id GROUP BY 1"""


STUDY_SLATE = 20


@query("evl_ranking_study", _STUDY, _V)
def evl_ranking_study(t):
    """Baseline, diversified and diversified-with-exploration slates of 20 against the oracle."""
    w = materialize(weights(t), "study_weights")
    tokens = t.items_b.select("item_id", R.style_tokens(t.items_b, R.MMR_FAMILIES).alias("tokens"))
    base = materialize(R.preference_topk(w, t.items_b, 80, BOUNDS), "study_base")
    # Exploration reads twice the slate; the re-ranked rows are read by two variants.
    first = lambda r: S.mmr(r, 0.95, 80, need=2 * STUDY_SLATE)
    mmr = materialize(S.unpack(S.reorder(S.slate_rows(base.join(tokens, "item_id")), first)).select(
        "session_id", "item_id", F.col("position").alias("rank")), "study_mmr")
    rate = R.adaptive_rate(0.08, F.col("confidence"))
    conf = P.preference_confidence(w)
    def variant(name, df, r):
        out = R.explore(df.join(conf, "session_id").select("session_id", "item_id", "rank", "confidence"), r, STUDY_SLATE, seed=3)
        return out.select(F.lit(name).alias("variant"), "session_id", F.col("rank").alias("position"), "item_id")
    slates = variant("baseline", base, F.lit(0.08)).unionByName(variant("mmr", mmr, F.lit(0.08))).unionByName(variant("mmr_adaptive", mmr, rate))
    return E.ranking_study(materialize(slates.join(tokens, "item_id"), "study_slates"), R.preference_topk(w, t.items_b, 20, BOUNDS, positive_only=True))
