"""Preference, persona and onboarding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import preferences as P
from larkspur.plans.q_joins import as_of
from larkspur.plans.q_quality import sql_r4
from larkspur.plans.registry import query

BOUNDS = (920, 940, 960, 980)
_V = "items_b swipes_b"

FEAT = """feat AS (SELECT item_id, word2 AS key FROM items_b UNION ALL SELECT item_id, type_tag FROM items_b
    UNION ALL SELECT item_id, 'material:' || material FROM items_b UNION ALL SELECT item_id, 'color:' || color_family FROM items_b WHERE color_family IS NOT NULL
    UNION ALL SELECT item_id, 'size:' || size_class FROM items_b WHERE size_class IS NOT NULL UNION ALL SELECT item_id, 'brand:' || lower(brand) FROM items_b
    UNION ALL SELECT item_id, 'price_bucket:' || CASE WHEN price_amount <= 920 THEN 'budget' WHEN price_amount <= 940 THEN 'affordable' WHEN price_amount <= 960 THEN 'mid' WHEN price_amount <= 980 THEN 'premium' ELSE 'luxury' END FROM items_b
    UNION ALL SELECT item_id, 'seats:' || seat_count FROM items_b)"""
WEIGHTS = f"""{FEAT}, w AS (SELECT s.session_id, f.key, CAST(sum(CASE WHEN direction = 'right' THEN 1.00 ELSE -0.35 END) AS DECIMAL(12,2)) AS weight
    FROM swipes_b s JOIN feat f ON f.item_id = s.item_id GROUP BY ALL)"""
TOP14 = """t14 AS (SELECT * FROM (SELECT session_id, key, weight, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, key) AS rank FROM w WHERE weight > 0) WHERE rank <= 14)"""


def weights(t):
    return P.learn_weights(t.swipes_b, t.items_b, BOUNDS)


@query("agg_item_features", f"WITH {FEAT} SELECT key, count(*) AS items FROM feat GROUP BY key", "items_b")
def agg_item_features(t):
    return P.item_features(t.items_b, BOUNDS).groupBy("key").agg(F.count("*").alias("items"))


@query("agg_preference_weights", f"WITH {WEIGHTS} SELECT session_id, key, CAST(weight AS DOUBLE) AS weight FROM w", _V)
def agg_preference_weights(t):
    return weights(t).withColumn("weight", F.col("weight").cast("double"))


@query("top_preference_keys", f"WITH {WEIGHTS}, {TOP14} SELECT session_id, key, CAST(weight AS DOUBLE) AS weight, rank FROM t14", _V)
def top_preference_keys(t):
    return P.top_keys(weights(t)).select("session_id", "key", F.col("weight").cast("double").alias("weight"), F.col("rank").cast("bigint").alias("rank"))


@query("agg_pref_confidence", f"""WITH {WEIGHTS} SELECT session_id, {sql_r4("coalesce(CAST(max(weight) FILTER (WHERE weight > 0) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE weight > 0) AS DOUBLE), 0)")} AS confidence
    FROM w GROUP BY session_id""", _V)
def agg_pref_confidence(t):
    return P.preference_confidence(weights(t)).withColumn("confidence", F.floor(F.col("confidence") * 1e4 + 0.5) / 1e4)


# Half-lives are counted from the newest event.
PERSONA = f"""a AS (SELECT max(ts) AS m FROM interactions_b),
  picks AS (SELECT DISTINCT session_id, session_id % 12 AS pick_hash FROM interactions_b),
  sz AS (SELECT pick_hash, count(*) AS n FROM picks GROUP BY 1 HAVING count(*) >= 2),
  sig AS (SELECT session_id, item_id, ts, 1.0::DOUBLE AS wt, 'like' AS k FROM likes_i
    UNION ALL SELECT session_id, item_id, min(ts), 0.35, 'right' FROM swipes_b WHERE direction = 'right' GROUP BY 1, 2
    UNION ALL SELECT session_id, item_id, min(ts), 0.55, 'click' FROM interactions_b WHERE event_type = 'click' GROUP BY 1, 2),
  pr AS (SELECT p.pick_hash, s.item_id, any_value(sz.n) AS user_count, sum(wt * greatest(0.25, least(1.0, exp(-ln(2) * date_diff('microsecond', s.ts, a.m) / 86400e6 / 45.0)))) AS raw,
      count(DISTINCT s.session_id) AS supporting_sessions, count(*) FILTER (WHERE k = 'like') AS like_count, count(*) FILTER (WHERE k = 'right') AS swipe_right_count,
      count(*) FILTER (WHERE k = 'click') AS outbound_click_count
    FROM sig s JOIN picks p USING (session_id) JOIN sz USING (pick_hash), a GROUP BY 1, 2),
  pn AS (SELECT *, {sql_r4('raw')} AS raw_score, {sql_r4('raw / user_count')} AS normalized_score FROM pr),
  per AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pick_hash ORDER BY raw_score DESC, item_id) AS rank FROM pn) WHERE rank <= 50)"""
PV = "interactions_b likes_i swipes_b"


def personas(t):
    picks = t.interactions_b.selectExpr("session_id", "session_id % 12 AS pick_hash").distinct()
    clicks = t.interactions_b.where("event_type = 'click'")
    return P.persona_signals(picks, t.likes_i, t.swipes_b, clicks, as_of(t))


@query("agg_persona_signals", f"""WITH {PERSONA} SELECT pick_hash, item_id, rank, user_count, raw_score, normalized_score, supporting_sessions, like_count, swipe_right_count, outbound_click_count FROM per""", PV)
def agg_persona_signals(t):
    return personas(t).withColumn("rank", F.col("rank").cast("bigint"))


# ---- onboarding --------------------------------------------------------------------------------------


@query("agg_pick_attributes", """WITH h AS (SELECT session_id, picked, unnest(picked[1:3]) AS item_id FROM picks_b),
    tr AS (SELECT h.session_id, i.word2, i.type_tag, i.material, i.color_family FROM h JOIN items_b i ON i.item_id = h.item_id),
    tg AS (SELECT session_id, string_agg(DISTINCT x, ',' ORDER BY x) AS style_tags FROM (SELECT session_id, word2 AS x FROM tr UNION ALL SELECT session_id, type_tag FROM tr) GROUP BY 1),
    mc AS (SELECT session_id, string_agg(DISTINCT material, ',' ORDER BY material) AS materials, coalesce(string_agg(DISTINCT color_family, ',' ORDER BY color_family), '') AS color_families FROM tr GROUP BY 1)
    SELECT p.session_id, array_to_string(list_sort(list_transform(p.picked, lambda x: CAST(x AS VARCHAR))), '-') AS pick_hash, tg.style_tags, mc.materials, mc.color_families
    FROM picks_b p JOIN tg USING (session_id) JOIN mc USING (session_id)""", "picks_b items_b")
def agg_pick_attributes(t):
    a = P.pick_attributes(t.picks_b, t.items_b)
    return a.select("session_id", "pick_hash", *[F.array_join(c, ",").alias(c) for c in ("style_tags", "materials", "color_families")])


def profiles(t):
    return t.onboarding_b.withColumns({"scenes": F.array("scene1", "scene2"), "vibes": F.array("vibe1")})


_SC = "list_filter([lower(trim(scene1)), scene2], lambda x: x IS NOT NULL)"
_VB = "list_filter([vibe1], lambda x: x IS NOT NULL)"


@query("agg_onboarding_profile", f"""WITH p AS (SELECT *, {_SC} AS sc, {_VB} AS vb FROM onboarding_b),
    l AS (SELECT *, list_concat(sc, vb) AS b, list_filter([{", ".join(f"CASE WHEN list_contains({'sc' if c == 'scenes' else 'vb'}, '{v}') THEN '{x}' END" if v else f"CASE WHEN {c} THEN '{x}' END" for c, v, x in P.EXPLANATIONS)}], lambda x: x IS NOT NULL) AS ex FROM p)
    SELECT session_id, b[1] AS primary_style, b[2] AS secondary_style, least(0.95::DOUBLE, floor((least(0.45::DOUBLE, len(sc) * 0.225::DOUBLE) + least(0.35::DOUBLE, len(vb) * 0.175::DOUBLE)
       + least(0.2::DOUBLE, ((CASE WHEN budget_band IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN seat_count IS NOT NULL THEN 1 ELSE 0 END) + modular_only::INT + kids_pets::INT + small_space::INT) * 0.04::DOUBLE)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS confidence,
      array_to_string(ex[1:4], '|') AS explanation, array_to_string(list_sort(b), '-') AS pick_hash FROM l""", "onboarding_b")
def agg_onboarding_profile(t):
    return P.derived_profile(profiles(t)).withColumn("explanation", F.array_join("explanation", "|"))


_MAP = ", ".join([f"('{s}', '{k}', {P.SCENE_BOOST})" for s, ks in P.SCENE_SIGNALS.items() for k in ks]
                 + [f"('{s}', '{k}', {P.VIBE_BOOST})" for s, ks in P.VIBE_SIGNALS.items() for k in ks])
_PRIORS = f"""map(tok, key, weight) AS (VALUES {_MAP}),
    tk AS (SELECT session_id, lower(trim(scene1)) AS tok FROM onboarding_b UNION ALL SELECT session_id, scene2 FROM onboarding_b UNION ALL SELECT session_id, vibe1 FROM onboarding_b),
    pri AS (SELECT session_id, key, max(weight) AS weight FROM (SELECT session_id, key, weight FROM tk JOIN map USING (tok)
      UNION ALL SELECT session_id, 'feature:modular', 3.00 FROM onboarding_b WHERE modular_only UNION ALL SELECT session_id, 'feature:small_space', 2.90 FROM onboarding_b WHERE small_space
      UNION ALL SELECT session_id, 'material:fabric', 2.50 FROM onboarding_b WHERE kids_pets) GROUP BY 1, 2)"""


@query("agg_onboarding_weights", f"WITH {_PRIORS} SELECT session_id, key, CAST(weight AS DOUBLE) AS weight FROM pri", "onboarding_b")
def agg_onboarding_weights(t):
    return P.onboarding_weights(profiles(t)).withColumn("weight", F.col("weight").cast("double"))


@query("agg_merged_weights", f"""WITH {WEIGHTS}, {_PRIORS}, few AS (SELECT session_id FROM swipes_b GROUP BY 1 HAVING count(*) >= 60),
    h AS (SELECT session_id, unnest(picked[1:3]) AS item_id FROM picks_b),
    pk AS (SELECT DISTINCT session_id, key FROM h JOIN feat USING (item_id) WHERE key NOT LIKE 'brand:%' AND key NOT LIKE 'size:%' AND key NOT LIKE 'price_bucket:%' AND key NOT LIKE 'seats:%'),
    u AS (SELECT session_id, key, weight, 0 AS r FROM w UNION ALL SELECT session_id, key, 3.00, 1 FROM pk WHERE session_id NOT IN (SELECT session_id FROM few)
      UNION ALL SELECT session_id, key, weight, 2 FROM pri WHERE session_id NOT IN (SELECT session_id FROM few))
    SELECT session_id, key, CAST(arg_min(weight, r) AS DOUBLE) AS weight FROM u GROUP BY 1, 2""", "items_b swipes_b onboarding_b picks_b")
def agg_merged_weights(t):
    picks = P.pick_weights(P.pick_attributes(t.picks_b, t.items_b))
    counts = t.swipes_b.groupBy("session_id").agg(F.count("*").alias("n_swipes"))
    merged = P.merge_weights(weights(t), picks, P.onboarding_weights(profiles(t)), counts, limited=60)
    return merged.withColumn("weight", F.col("weight").cast("double"))
