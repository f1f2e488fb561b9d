"""Catalog quality, image health, metrics and event-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import events as E
from larkspur.operators import normalize as N
from larkspur.operators import quality as Q
from larkspur.plans.registry import query


def r4(c):
    return F.floor(c * 1e4 + 0.5) / 1e4


def sql_r4(c: str) -> str:
    return f"floor(({c}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


@query("agg_catalog_qa", """SELECT count(*) AS total, count(*) FILTER (WHERE price_amount IS NULL OR price_amount = 0) AS missing_price,
    count(*) FILTER (WHERE width_cm IS NULL AND height_cm IS NULL) AS missing_dimensions, count(*) FILTER (WHERE image_count = 0) AS missing_images,
    count(*) FILTER (WHERE trim(outbound_url) = '') AS missing_outbound_url, count(*) FILTER (WHERE category IS NULL) AS missing_tags
    FROM items_q WHERE is_active""", "items_q")
def agg_catalog_qa(t):
    return Q.catalog_qa(t.items_q.withColumn("style_tags", F.array_compact(F.array("category"))))


_COMPLETE = """(3 + 3 + CASE WHEN image_count > 0 THEN 2 ELSE 0 END + CASE WHEN coalesce(price_amount, 0) > 0 THEN 2 ELSE 0 END
    + CASE WHEN width_cm IS NOT NULL THEN 1 ELSE 0 END + 1 + CASE WHEN color_family IS NOT NULL THEN 1 ELSE 0 END + 1) / 17.0::DOUBLE"""


@query("agg_completeness", f"SELECT source_id, count(*) AS items, {sql_r4(f'avg({_COMPLETE})')} AS mean_completeness FROM items_q GROUP BY source_id", "items_q")
def agg_completeness(t):
    score = Q.completeness({
        "title": F.col("title").isNotNull(), "canonical": F.lit(True), "images": F.col("image_count") > 0,
        "price_amount": F.col("price_amount") > 0, "dimensions": F.col("width_cm").isNotNull(),
        "material": F.col("material").isNotNull(), "color": F.col("color_family").isNotNull(), "brand": F.col("brand").isNotNull()})
    return t.items_q.groupBy("source_id").agg(F.count("*").alias("items"), r4(F.avg(score)).alias("mean_completeness"))


@query("agg_missing_fields", """SELECT field, count(*) AS items FROM (SELECT unnest([CASE WHEN trim(outbound_url) = '' THEN 'description' END,
      CASE WHEN width_cm IS NULL THEN 'dimensions' END, CASE WHEN color_family IS NULL THEN 'color' END]) AS field FROM items_q) WHERE field IS NOT NULL GROUP BY field""", "items_q")
def agg_missing_fields(t):
    fields = N.missing_fields({"description": F.col("outbound_url"), "dimensions": F.col("width_cm"), "material": F.col("material"),
                               "color": F.col("color_family"), "brand": F.col("brand")})
    return t.items_q.select(F.explode(fields).alias("field")).groupBy("field").agg(F.count("*").alias("items"))


@query("flt_needs_validation", """SELECT item_id FROM items_q WHERE NOT coalesce(validated AND analyzed_images > 0 AND selected_image <> '' AND
    coalesce(scene_type, '') <> '' AND creative_score IS NOT NULL, false)""", "items_q")
def flt_needs_validation(t):
    return t.items_q.where(Q.needs_validation(t.items_q)).select("item_id")


@query("flt_refetch", "SELECT item_id FROM items_q WHERE item_id % 10 < 6 AND fetch_method = 'HTTP' AND updated_day <= 299", "items_q")
def flt_refetch(t):
    items = t.items_q.withColumn("updated_at", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(updated_day as int))"))
    as_of = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(300)")
    return Q.refetch_candidates(items, as_of).select("item_id")


_STATUS = "CASE WHEN image_count = 0 THEN 'none' WHEN item_id % 6 = 0 THEN 'broken' ELSE 'valid' END"


@query("agg_image_health", f"""WITH s AS (SELECT *, {_STATUS} AS status FROM items_q),
    b AS (SELECT source_id, title, item_id, row_number() OVER (PARTITION BY source_id ORDER BY item_id) AS rn FROM s WHERE status = 'broken')
    SELECT s.source_id, count(*) AS total_items, count(*) FILTER (WHERE status = 'valid') AS valid_image, count(*) FILTER (WHERE status = 'none') AS no_image,
      count(*) FILTER (WHERE status = 'broken') AS likely_broken, floor(count(*) FILTER (WHERE status = 'valid') / count(*) * 100.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS health_pct,
      coalesce((SELECT string_agg(title, '|' ORDER BY rn) FROM b WHERE b.source_id = s.source_id AND rn <= 3), '') AS samples
    FROM s GROUP BY s.source_id""", "items_q")
def agg_image_health(t):
    url = "concat('https://shop.example/', IF(item_id % 6 = 0, 'produkt/thing-', 'images/'), item_id)"
    items = t.items_q.selectExpr("item_id", "source_id", "title", f"IF(image_count = 0, null, array({url})) AS image_urls")
    return Q.image_health(items).withColumn("samples", F.array_join("samples", "|"))


@query("agg_classification_stats", """WITH a AS (SELECT CAST(source_id AS VARCHAR) AS s, coalesce(category, 'unclassified') AS c, coalesce(decision, 'unprocessed') AS d, category IS NOT NULL AS k FROM items_q WHERE is_active)
    SELECT 'category' AS dimension, c AS value, count(*) AS total, count(*) FILTER (WHERE k) AS classified, count(*) FILTER (WHERE d = 'ACCEPT') AS accepted FROM a GROUP BY c
    UNION ALL SELECT 'decision', d, count(*), count(*) FILTER (WHERE k), count(*) FILTER (WHERE d = 'ACCEPT') FROM a GROUP BY d
    UNION ALL SELECT 'source', s, count(*), count(*) FILTER (WHERE k), count(*) FILTER (WHERE d = 'ACCEPT') FROM a GROUP BY s""", "items_q")
def agg_classification_stats(t):
    return Q.classification_stats(t.items_q)


@query("agg_source_summary", """SELECT source_id, count(*) AS active_items, count(category) AS classified FROM items_q WHERE is_active GROUP BY source_id
    ORDER BY active_items DESC, source_id LIMIT 8""", "items_q")
def agg_source_summary(t):
    return Q.source_summary(t.items_q)


@query("agg_creative_stats", """SELECT count(*) AS total, count(creative_score) AS validated, count(*) - count(creative_score) AS not_validated,
    count(*) FILTER (WHERE creative_score IS NOT NULL AND band = 'green') AS green, count(*) FILTER (WHERE creative_score IS NOT NULL AND band = 'yellow') AS yellow,
    count(*) FILTER (WHERE creative_score IS NOT NULL AND band = 'red') AS red, count(*) FILTER (WHERE creative_score IS NOT NULL AND scene_type = 'contextual') AS contextual,
    count(*) FILTER (WHERE creative_score IS NOT NULL AND scene_type = 'studio_cutout') AS studio_cutout, count(*) FILTER (WHERE creative_score IS NOT NULL AND scene_type IS NULL) AS unknown_scene,
    CAST(floor(avg(creative_score) + 0.5) AS BIGINT) AS average_score,
    count(*) FILTER (WHERE creative_score IS NOT NULL AND issue = 'broken') AS broken FROM items_q WHERE is_active""", "items_q")
def agg_creative_stats(t):
    stats = Q.creative_stats(t.items_q)
    issues = Q.issue_counts(t.items_q.withColumn("issues", F.filter(F.array("issue"), lambda i: i != "")))
    broken = issues.where("issue = 'broken'").agg(F.coalesce(F.sum("items"), F.lit(0))).scalar()
    return stats.withColumn("broken", broken)


_SCENE = """sc AS (SELECT *, (near_white_ratio >= 0.62 AND border_ratio >= 0.78 AND background_ratio >= 0.68) AS white,
      CASE WHEN (transparent_ratio >= 0.08 AND background_ratio >= 0.66 AND border_ratio >= 0.72) OR
        (near_white_ratio >= 0.62 AND border_ratio >= 0.78 AND background_ratio >= 0.68 AND texture_score < 0.07) THEN 'studio_cutout'
      WHEN background_ratio <= 0.58 AND border_ratio <= 0.62 AND texture_score >= 0.09 AND subject_coverage >= 0.35 THEN 'contextual' ELSE 'unknown' END AS scene_type FROM image_meta_b),
    sd AS (SELECT *, CAST(CASE WHEN NOT valid THEN 0 ELSE least(100, greatest(0, 70
      + CASE WHEN least(width, height) < 400 THEN -45 WHEN least(width, height) < 800 THEN -15 WHEN least(width, height) >= 1200 THEN 8 ELSE 0 END
      + CASE WHEN scene_type = 'contextual' THEN 18 WHEN scene_type = 'studio_cutout' THEN -25 ELSE 0 END
      - CASE WHEN transparent_ratio >= 0.12 THEN 12 ELSE 0 END - CASE WHEN near_white_ratio >= 0.7 AND border_ratio >= 0.78 THEN 8 ELSE 0 END
      + floor((texture_score - 0.08::DOUBLE) * 120.0::DOUBLE + 0.5::DOUBLE) - floor(abs(subject_coverage - 0.55::DOUBLE) * 20.0::DOUBLE + 0.5::DOUBLE))) END AS BIGINT) AS display_suitability,
      concat_ws(',', CASE WHEN transparent_ratio >= 0.12 THEN 'transparent-background' END, CASE WHEN white THEN 'white-background' END,
        CASE WHEN scene_type = 'studio_cutout' THEN 'studio-cutout' END,
        CASE WHEN scene_type <> 'contextual' AND background_ratio >= 0.72 THEN 'low-context-scene' END) AS scene_issues FROM sc)"""


@query("agg_scene_type", f"WITH {_SCENE} SELECT item_id, position, scene_type, display_suitability, scene_issues FROM sd", "image_meta_b")
def agg_scene_type(t):
    return Q.scene_type(t.image_meta_b).select(
        "item_id", "position", "scene_type", "display_suitability", F.array_join("scene_issues", ",").alias("scene_issues"))


@query("agg_creative_scores", f"""WITH {_SCENE},
    im AS (SELECT *, CAST(CASE WHEN NOT valid THEN 0 ELSE least(100, greatest(0, floor((100 - CASE WHEN least(width, height) < 400 THEN 40 WHEN least(width, height) < 800 THEN 15 ELSE 0 END
        - CASE WHEN width / height > 3.0 OR width / height < 0.33 THEN 25 WHEN width / height > 1.8 OR width / height < 0.6 THEN 10 ELSE 0 END
        - CASE WHEN contains(scene_issues, 'transparent-background') THEN 8 ELSE 0 END - CASE WHEN contains(scene_issues, 'white-background') THEN 8 ELSE 0 END
        - CASE WHEN contains(scene_issues, 'studio-cutout') THEN 12 ELSE 0 END) * 0.45::DOUBLE + display_suitability * 0.55::DOUBLE + 0.5::DOUBLE))) END AS BIGINT) AS creative FROM sd),
    rk AS (SELECT *, {sql_r4("display_suitability * 0.7::DOUBLE + creative * 0.3::DOUBLE + CASE WHEN scene_type = 'contextual' THEN 6.0::DOUBLE WHEN scene_type = 'studio_cutout' THEN -6.0::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN valid THEN 0.0::DOUBLE ELSE 20.0::DOUBLE END")} AS r FROM im),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN valid AND scene_type <> 'studio_cutout' THEN 0 ELSE 1 END, r DESC, position) AS rn,
        avg(creative) OVER (PARTITION BY item_id) AS mean, count(*) OVER (PARTITION BY item_id) AS images FROM rk),
    f AS (SELECT item_id, position AS selected_position, scene_type, images, CAST(least(100, greatest(0, floor(creative * 0.75::DOUBLE + mean * 0.25::DOUBLE + 0.5::DOUBLE))) AS BIGINT) AS score FROM o WHERE rn = 1)
    SELECT *, CASE WHEN score >= 75 THEN 'green' WHEN score >= 45 THEN 'yellow' ELSE 'red' END AS band FROM f""", "image_meta_b")
def agg_creative_scores(t):
    return Q.creative_scores(Q.scene_type(t.image_meta_b).withColumnRenamed("scene_issues", "issues"))


@query("agg_creative_scores_v1", """WITH s AS (SELECT *, CAST(CASE WHEN NOT valid THEN 0 ELSE greatest(0, 100 - CASE WHEN least(width, height) < 400 THEN 40 WHEN least(width, height) < 800 THEN 15 ELSE 0 END
        - CASE WHEN width / height > 3.0 OR width / height < 1.0 / 3 THEN 25 WHEN width / height > 1.8 OR width / height < 0.6 THEN 10 ELSE 0 END
        - CASE WHEN file_size < 10000 THEN 20 WHEN file_size > 5000000 THEN 10 ELSE 0 END) END AS BIGINT) AS s FROM image_meta_b),
    a AS (SELECT item_id, arg_min(s, position) AS p, arg_min(valid, position) AS primary_valid, CAST(sum(s) AS BIGINT) AS total, count(*) AS images, count(*) FILTER (WHERE valid) AS valid_images FROM s GROUP BY item_id),
    o AS (SELECT *, CASE WHEN images = 1 THEN p ELSE floor(p * 0.7::DOUBLE + (total - p) / (images - 1) * 0.3::DOUBLE + 1e-9::DOUBLE) END AS v FROM a),
    f AS (SELECT item_id, images, valid_images, primary_valid, CAST(CASE WHEN primary_valid THEN v ELSE least(v, 25) END AS BIGINT) AS score FROM o)
    SELECT *, CASE WHEN score >= 75 THEN 'green' WHEN score >= 45 THEN 'yellow' ELSE 'red' END AS band FROM f""", "image_meta_b")
def agg_creative_scores_v1(t):
    return Q.creative_scores_v1(t.image_meta_b)


# ---- dated metrics -----------------------------------------------------------------------

_RATE = lambda cond: f"CASE WHEN count(*) FILTER (WHERE success) > 0 THEN count(*) FILTER (WHERE success AND {cond}) / count(*) FILTER (WHERE success) ELSE 0.0::DOUBLE END"
_DAILY = f"""daily AS (SELECT source_id, dt, count(*) AS urls_extracted, count(*) FILTER (WHERE success) AS successes,
      count(*) FILTER (WHERE success) / count(*) AS success_rate,
      CASE WHEN count(*) FILTER (WHERE success) > 0 THEN sum(completeness) FILTER (WHERE success) / count(*) FILTER (WHERE success) ELSE 0.0::DOUBLE END AS avg_completeness,
      {_RATE("method = 'jsonld'")} AS jsonld_rate, {_RATE("method = 'embedded_json'")} AS embedded_json_rate, {_RATE("method = 'dom'")} AS dom_rate,
      {_RATE('has_description')} AS description_rate, {_RATE('has_dimensions')} AS dimensions_rate FROM extracts_b GROUP BY source_id, dt)"""
_METRICS = ["success_rate", "avg_completeness", "jsonld_rate", "embedded_json_rate", "dom_rate", "description_rate", "dimensions_rate"]


@query("agg_metrics_daily", f"WITH {_DAILY} SELECT source_id, dt, urls_extracted, successes, {', '.join(f'{sql_r4(m)} AS {m}' for m in _METRICS)} FROM daily", "extracts_b")
def agg_metrics_daily(t):
    daily = Q.metrics_daily(t.extracts_b)
    return daily.select("source_id", "dt", "urls_extracted", "successes", *[r4(F.col(m)).alias(m) for m in _METRICS])


@query("win_drift", f"""WITH {_DAILY}, w AS (SELECT *, avg(success_rate) OVER win AS bs, avg(avg_completeness) OVER win AS bc FROM daily
      WINDOW win AS (PARTITION BY source_id ORDER BY dt ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT source_id, dt, {sql_r4('bs')} AS baseline_success, {sql_r4('bc')} AS baseline_completeness,
      concat_ws(',', CASE WHEN success_rate < 0.7 THEN 'success_rate_below_0.7' END, CASE WHEN floor((bc - avg_completeness) * 1e9 + 0.5) / 1e9 >= 0.2 THEN 'avg_completeness_drop_0.2' END) AS reasons FROM w""", "extracts_b")
def win_drift(t):
    d = Q.drift(Q.metrics_daily(t.extracts_b))
    return d.select("source_id", "dt", r4(F.col("baseline_success")).alias("baseline_success"),
                    r4(F.col("baseline_completeness")).alias("baseline_completeness"), F.array_join("reasons", ",").alias("reasons"))


@query("agg_domain_dashboard", f"""WITH {_DAILY},
    src AS (SELECT '1-URGENT' AS source_id UNION ALL SELECT '2-HIGH' UNION ALL SELECT '3-MEDIUM'),
    st AS (SELECT (['1-URGENT', '2-HIGH', '3-MEDIUM'])[1 + source_id % 3] AS source_id, count(*) AS items, count(category) AS classified, count(*) FILTER (WHERE decision = 'ACCEPT') AS accepted FROM items_q WHERE is_active GROUP BY 1)
    SELECT d.source_id, max(dt) AS latest_dt, {sql_r4('arg_max(success_rate, dt)')} AS success_rate, {sql_r4('arg_max(avg_completeness, dt)')} AS avg_completeness,
      count(*) AS history_days, {sql_r4('avg(success_rate)')} AS mean_success_rate, coalesce(any_value(items), 0) AS items, coalesce(any_value(classified), 0) AS classified, coalesce(any_value(accepted), 0) AS accepted
    FROM daily d LEFT JOIN st ON st.source_id = d.source_id GROUP BY d.source_id""", "extracts_b items_q")
def agg_domain_dashboard(t):
    items = t.items_q.withColumn("source_id", F.expr("element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM'), cast(1 + source_id % 3 as int))"))
    d = Q.domain_dashboard(Q.metrics_daily(t.extracts_b), items)
    return d.withColumns({c: r4(F.col(c)) for c in ("success_rate", "avg_completeness", "mean_success_rate")})


@query("agg_cost_telemetry", """SELECT source_id, count(*) AS total_runs, CAST(sum(CASE WHEN fetched > 0 THEN fetched ELSE candidate_urls END) AS BIGINT) AS total_fetched,
      CAST(sum(CASE WHEN success > 0 THEN success ELSE upserted END) AS BIGINT) AS total_items_written, CAST(sum(duration_sec) AS BIGINT) AS total_duration_sec,
      arg_max(status, struct_pack(a := started_at, b := run_id)) AS last_run_status,
      floor(sum(duration_sec) / count(*) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS avg_duration_sec,
      floor(sum(CASE WHEN fetched > 0 THEN fetched ELSE candidate_urls END) / count(*) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS avg_fetch_per_run FROM runs_b GROUP BY source_id""", "runs_b")
def agg_cost_telemetry(t):
    return Q.cost_telemetry(t.runs_b)


# ---- event log ---------------------------------------------------------------------------

_NEED = {
    "deck_response requires rank": ("event_name = 'deck_response'", "ranker_run_id IS NULL OR served_items IS NULL"),
    "card_impression_start requires item": ("event_name = 'card_impression_start'", "item_id IS NULL OR position_in_deck IS NULL"),
    "card_impression_start requires impression": ("event_name = 'card_impression_start'", "impression_id IS NULL"),
    "card_impression_end requires item": ("event_name = 'card_impression_end'", "item_id IS NULL OR position_in_deck IS NULL"),
    "card_impression_end requires impression": ("event_name = 'card_impression_end'", "impression_id IS NULL OR end_reason IS NULL"),
    "swipe requires item": ("event_name LIKE 'swipe%'", "item_id IS NULL OR position_in_deck IS NULL"),
    "swipe requires interaction": ("event_name LIKE 'swipe%'", "gesture IS NULL"),
    "filters_apply requires filters.active": ("event_name = 'filters_apply'", "filters_active IS NULL"),
    "outbound_click requires item": ("event_name = 'outbound_click'", "item_id IS NULL"),
    "outbound_click requires outbound": ("event_name = 'outbound_click'", "destination_domain IS NULL"),
    "detail_open requires item and surface": ("event_name = 'detail_open'", "item_id IS NULL OR surface_name IS NULL"),
}
_ERROR = ("CASE WHEN event_name IS NULL THEN 'missing required fields' WHEN length(event_id) < 8 THEN 'invalid eventId' "
          + " ".join(f"WHEN {n} AND ({c}) THEN '{m}'" for m, (n, c) in _NEED.items()) + " END")


@query("flt_valid_events", f"SELECT coalesce(event_name, '-') AS event_name, coalesce({_ERROR}, 'ok') AS outcome, count(*) AS events FROM events_v1_b GROUP BY ALL", "events_v1_b")
def flt_valid_events(t):
    return E.validate_events(t.events_v1_b).groupBy(
        F.coalesce("event_name", F.lit("-")).alias("event_name"), F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("events"))


@query("evl_event_qa", """WITH l AS (SELECT *, lag(client_seq) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM events_v1_b)
    SELECT 'client_seq_increases' AS invariant, count(*) AS violations FROM l WHERE client_seq <= prev
    UNION ALL SELECT 'impression_end_has_start', count(*) FROM events_v1_b WHERE event_name = 'card_impression_end' AND impression_id IS NOT NULL
       AND impression_id NOT IN (SELECT impression_id FROM events_v1_b WHERE event_name = 'card_impression_start' AND impression_id IS NOT NULL)
    UNION ALL SELECT 'filters_snapshot_present', count(*) FROM events_v1_b WHERE event_name = 'filters_apply' AND filters_active IS NULL
    UNION ALL SELECT 'swipe_has_item_and_position', count(*) FROM events_v1_b WHERE event_name LIKE 'swipe%' AND (item_id IS NULL OR position_in_deck IS NULL)
    UNION ALL SELECT 'outbound_has_domain', count(*) FROM events_v1_b WHERE event_name = 'outbound_click' AND destination_domain IS NULL""", "events_v1_b")
def evl_event_qa(t):
    return E.event_qa(t.events_v1_b)


@query("agg_dwell_buckets", """SELECT CASE WHEN visible_ms < 1000 THEN '0_1s' WHEN visible_ms < 3000 THEN '1_3s' WHEN visible_ms < 8000 THEN '3_8s' ELSE '8s_plus' END AS bucket,
    count(*) AS impressions, CAST(sum(visible_ms) AS BIGINT) AS total_ms FROM events_v1_b WHERE event_name = 'card_impression_end' GROUP BY 1""", "events_v1_b")
def agg_dwell_buckets(t):
    return E.dwell_buckets(t.events_v1_b)
