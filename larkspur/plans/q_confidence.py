"""Confidence-score queries over interactions and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import confidence as C
from larkspur.plans.registry import query

_COUNTS_SQL = "\nUNION ALL ".join(
    f"""SELECT item_id, '{w}' AS time_window,
        count(*) FILTER (WHERE is_impression AND ts >= a.as_of - INTERVAL {d} DAY) AS impressions,
        count(*) FILTER (WHERE is_save AND ts >= a.as_of - INTERVAL {d} DAY) AS saves,
        count(*) FILTER (WHERE is_click AND ts >= a.as_of - INTERVAL {d} DAY) AS clicks,
        count(*) FILTER (WHERE is_skip AND ts >= a.as_of - INTERVAL {d} DAY) AS skips
    FROM interactions_b, (SELECT max(ts) AS as_of FROM interactions_b) a
    GROUP BY item_id"""
    for w, d in C.WINDOWS.items()
)

SCORES_SQL = f"""
counts AS ({_COUNTS_SQL}),
rated AS (
  SELECT i.item_id, w.time_window, i.creative_score,
         coalesce(c.impressions, 0) AS impressions, coalesce(c.saves, 0) AS saves,
         coalesce(c.clicks, 0) AS clicks, coalesce(c.skips, 0) AS skips
  FROM items_b i CROSS JOIN (VALUES ('7d'), ('30d'), ('90d')) w(time_window)
  LEFT JOIN counts c ON c.item_id = i.item_id AND c.time_window = w.time_window
  WHERE i.is_active),
rates AS (
  SELECT *, CASE WHEN impressions > 0 THEN saves / impressions ELSE 0.0::DOUBLE END AS sr,
            CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0.0::DOUBLE END AS cr,
            CASE WHEN impressions > 0 THEN skips / impressions ELSE 0.0::DOUBLE END AS kr
  FROM rated),
scores AS (
  SELECT *, CAST(least(100, greatest(0, floor((
      least(100.0::DOUBLE, ((saves + 2.0::DOUBLE) / (impressions + 100.0::DOUBLE)) * 2000.0::DOUBLE) * 50.0::DOUBLE
      + least(100.0::DOUBLE, cr * 1000.0::DOUBLE) * 15.0::DOUBLE
      + CASE WHEN impressions = 0 THEN 0.0::DOUBLE ELSE
          least(100.0::DOUBLE, greatest(0.0::DOUBLE,
            log10(impressions + 1.0::DOUBLE) / log10(500.0::DOUBLE) * 100.0::DOUBLE)) END * 15.0::DOUBLE
      + coalesce(creative_score, 70.0::DOUBLE) * 20.0::DOUBLE) / 100.0::DOUBLE + 0.5::DOUBLE))) AS BIGINT) AS score
  FROM rates),
final AS (
  SELECT item_id, time_window, score,
    CASE WHEN score >= 60 THEN 'green' WHEN score >= 30 THEN 'yellow' ELSE 'red' END AS band,
    impressions, saves, clicks, skips,
    floor(sr * 10000.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS save_rate,
    floor(cr * 10000.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS click_rate,
    floor(kr * 10000.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS skip_rate,
    concat_ws(',',
      CASE WHEN sr >= 0.05 THEN 'STRONG_SAVES' WHEN sr >= 0.03 THEN 'GOOD_SAVES'
           WHEN sr < 0.01 AND impressions >= 50 THEN 'LOW_SAVES' END,
      CASE WHEN cr >= 0.10 THEN 'HIGH_CLICKS' WHEN cr < 0.02 AND impressions >= 50 THEN 'LOW_CLICKS' END,
      CASE WHEN kr >= 0.8 THEN 'HIGH_SKIP' END,
      CASE WHEN impressions < 20 THEN 'LOW_VOLUME' WHEN impressions >= 500 THEN 'HIGH_CONFIDENCE' END,
      CASE WHEN creative_score >= 80 THEN 'EXCELLENT_CREATIVE' WHEN creative_score < 50 THEN 'CREATIVE_ISSUES' END
    ) AS reason_codes
  FROM scores)"""

_V = "items_b interactions_b"


def scores(t):
    return C.confidence_scores(t.items_b, t.interactions_b, t.interactions_b.agg(F.max("ts")).scalar())


def _flat(df):
    return df.withColumn("reason_codes", F.array_join("reason_codes", ",")).drop("creative_score")


@query("agg_product_events", f"WITH c AS ({_COUNTS_SQL}) SELECT * FROM c", _V)
def agg_product_events(t):
    return C.product_events(t.interactions_b, t.interactions_b.agg(F.max("ts")).scalar())


@query("agg_confidence_score", f"WITH {SCORES_SQL} SELECT * FROM final", _V)
def agg_confidence_score(t):
    return _flat(scores(t))


@query("agg_reason_codes", f"""WITH {SCORES_SQL}
    SELECT time_window, code, count(*) AS products
    FROM (SELECT time_window, unnest(string_split(reason_codes, ',')) AS code FROM final) x
    WHERE code <> '' GROUP BY time_window, code""", _V)
def agg_reason_codes(t):
    return (scores(t).select("time_window", F.explode("reason_codes").alias("code"))
            .groupBy("time_window", "code").agg(F.count("*").alias("products")))


@query("agg_score_summary", f"""WITH {SCORES_SQL}
    SELECT time_window, count(*) AS total_products,
      CAST(floor(avg(score) + 0.5) AS BIGINT) AS average_score,
      count(*) FILTER (WHERE band = 'green') AS green,
      count(*) FILTER (WHERE band = 'yellow') AS yellow,
      count(*) FILTER (WHERE band = 'red') AS red,
      CAST(floor(count(*) FILTER (WHERE band = 'green') / count(*) * 100.0 + 0.5) AS BIGINT) AS pct_green,
      CAST(floor(count(*) FILTER (WHERE band = 'yellow') / count(*) * 100.0 + 0.5) AS BIGINT) AS pct_yellow,
      CAST(floor(count(*) FILTER (WHERE band = 'red') / count(*) * 100.0 + 0.5) AS BIGINT) AS pct_red
    FROM final GROUP BY time_window""", _V)
def agg_score_summary(t):
    return C.score_summary(scores(t))


@query("top_scores_segment", f"""WITH {SCORES_SQL}
    SELECT item_id, score, band, impressions FROM final WHERE time_window = '30d'
    ORDER BY score DESC, item_id LIMIT 50""", _V)
def top_scores_segment(t):
    return C.query_scores(scores(t)).select("item_id", "score", "band", "impressions")


@query("top_scores_product", f"""WITH {SCORES_SQL}
    SELECT item_id, time_window, score, band FROM final WHERE item_id = 42""", _V)
def top_scores_product(t):
    return C.product_scores(scores(t), 42).select("item_id", "time_window", "score", "band")
