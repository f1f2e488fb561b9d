"""Bindings of the generated tables to the product-discovery data model.

Each view is plain SQL that reads the same in Spark and in DuckDB, apart from
a few dialect helpers, so a query and its oracle start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class SparkDialect:
    text = "STRING"

    def ref(self, name: str) -> str:
        return f"«{name}»"

    def finish(self, sql: str) -> str:
        """Literal braces are escaped; references become format fields."""
        sql = sql.replace("{", "{{").replace("}", "}}")
        return sql.replace("«", "{").replace("»", "}")

    def arr(self, *parts: str) -> str:
        return f"array({', '.join(parts)})"

    def json_long(self, col: str, key: str) -> str:
        return f"cast(get_json_object({col}, '$.{key}') as bigint)"

    def json_text(self, col: str, key: str) -> str:
        return f"get_json_object({col}, '$.{key}')"

    def rx(self, col: str, pattern: str, group: int) -> str:
        return f"regexp_extract({col}, r'{pattern}', {group})"

    def day(self, col: str) -> str:
        return f"date_format({col}, 'yyyy-MM-dd')"


class DuckDialect(SparkDialect):
    text = "VARCHAR"

    def ref(self, name: str) -> str:
        return name

    def finish(self, sql: str) -> str:
        return sql

    def arr(self, *parts: str) -> str:
        return f"[{', '.join(parts)}]"

    def json_long(self, col: str, key: str) -> str:
        return f"cast(json_extract_string({col}, '$.{key}') as bigint)"

    def json_text(self, col: str, key: str) -> str:
        return f"json_extract_string({col}, '$.{key}')"

    def rx(self, col: str, pattern: str, group: int) -> str:
        return f"regexp_extract({col}, '{pattern}', {group})"

    def day(self, col: str) -> str:
        return f"strftime({col}, '%Y-%m-%d')"


SPARK, DUCK = SparkDialect(), DuckDialect()

VIEWS: dict[str, tuple[tuple[str, ...], object]] = {}


def view(*deps: str):
    def register(fn):
        VIEWS[fn.__name__] = (deps, fn)
        return fn

    return register


def view_sql(name: str, dialect: SparkDialect) -> str:
    return dialect.finish(VIEWS[name][1](dialect))


def with_views(body: str, *names: str) -> str:
    """DuckDB statement: WITH clauses for the named views (and what they need), then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in RAW_TABLES or name in ordered:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({view_sql(n, DUCK)})" for n in ordered)
    body = body.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Raw tables and bound views of one data directory as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in RAW_TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._cache:
            if name in RAW_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                deps, _ = VIEWS[name]
                df = self.spark.sql(
                    view_sql(name, SPARK), **{d: getattr(self, d) for d in deps}
                )
            self._cache[name] = df
        return self._cache[name]


# --------------------------------------------------------------------------- catalog


@view("part")
def items_b(d):
    w1, w2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
    return f"""
    SELECT p_partkey AS item_id, p_name AS title, p_brand AS brand,
           p_retailprice AS price_amount, {w1} AS word1, {w2} AS word2,
           CASE WHEN {w1} IN ('red', 'blue') THEN {w1} END AS color_family,
           {w2} AS model_key,
           CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN lower(p_type) END AS size_class,
           CASE p_partkey % 4 WHEN 0 THEN 'fabric' WHEN 1 THEN 'leather'
                WHEN 2 THEN 'velvet' ELSE 'wood' END AS material,
           {d.arr(w2, 'lower(p_type)')} AS style_tags, lower(p_type) AS type_tag,
           CAST(120 + 3 * p_size AS BIGINT) AS width_cm,
           CAST(1 + p_size % 6 AS BIGINT) AS seat_count,
           p_partkey % 4 AS image_count, p_partkey % 20 AS source_id,
           p_partkey % 10 AS retailer, p_partkey % 11 <> 0 AS is_active,
           CASE WHEN p_partkey % 5 <> 0
                THEN CAST(30 + (p_partkey * 7) % 70 AS DOUBLE) END AS creative_score,
           (p_partkey * 37) % 365 AS updated_day, CAST(p_size AS BIGINT) AS p_size
    FROM {d.ref('part')}"""


@view("items_b")
def deck_items_b(d):
    """Items with what the deck's gates read: catalog control, images, surface decision, scene, url, taxonomy facets."""
    code = "concat(chr(CAST(97 + item_id % 23 AS INT)), chr(CAST(97 + (item_id * 7) % 25 AS INT)))"
    return f"""
    SELECT item_id, concat(word2, ' ', {code}, CASE item_id % 9 WHEN 0 THEN ' soffbord' WHEN 1 THEN ' stol' ELSE ' soffa' END) AS title, word2, {code} AS code,
           brand, price_amount, color_family, size_class, material, style_tags, type_tag, seat_count, image_count, source_id, retailer, is_active, creative_score, updated_day,
           CASE item_id % 13 WHEN 0 THEN false WHEN 1 THEN true END AS catalog_included,
           CASE item_id % 19 WHEN 0 THEN {d.arr("'No-Valid-Images'")} WHEN 1 THEN {d.arr("'low-contrast'")} END AS issues,
           item_id % 23 < 5 AS images_validated, item_id % 23 AS valid_image_count,
           CASE item_id % 17 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'ACCEPT' END AS decision, CASE item_id % 4 WHEN 0 THEN 'sofa' WHEN 1 THEN 'armchair' END AS category,
           CASE WHEN item_id % 8 <> 0 THEN concat('https://shop.example/p/', CAST(item_id % 900 AS {d.text})) END AS canonical_url,
           CASE item_id % 3 WHEN 0 THEN 'contextual' WHEN 1 THEN 'studio_cutout' END AS scene_type,
           CASE item_id % 5 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '4_plus' END AS seat_bucket, CASE item_id % 5 WHEN 3 THEN '2_seater' WHEN 4 THEN '3_seater' END AS sub_category,
           item_id % 3 = 0 AS modular, item_id % 4 = 1 AS small_space
    FROM {d.ref('items_b')}"""


# --------------------------------------------------------------------------- interactions


@view("events")
def interactions_b(d):
    return f"""
    SELECT event_id, ts, user_id AS session_id, {d.json_long('props', 'k')} AS item_id,
           event_type, value,
           event_type <> 'signup' AS is_impression,
           event_type = 'purchase' AND value >= 100 AS is_save,
           event_type = 'click' AND value >= 100 AS is_click,
           event_type = 'error' AS is_skip
    FROM {d.ref('events')}"""


@view("interactions_b")
def swipes_b(d):
    return f"""
    SELECT event_id, ts, session_id, item_id,
           CASE WHEN event_type = 'purchase' THEN 'right' ELSE 'left' END AS direction
    FROM {d.ref('interactions_b')} WHERE event_type IN ('purchase', 'error')"""


@view("interactions_b")
def deck_sessions_b(d):
    """Deck requests: one row per session, with its cohort, facet wishes and onboarding constraints."""
    return f"""
    SELECT session_id, CASE WHEN session_id % 6 <> 5 THEN session_id % 12 END AS pick_hash, session_id % 2 = 0 AS onboarded,
           CASE session_id % 10 WHEN 7 THEN 'small' END AS want_size_class, CASE session_id % 14 WHEN 1 THEN 'red' END AS want_color_family,
           CASE session_id % 5 WHEN 0 THEN '2' WHEN 1 THEN '3' END AS want_seat_bucket, session_id % 8 = 3 AS modular_only, session_id % 9 = 4 AS want_small_space,
           CASE session_id % 3 WHEN 0 THEN 920.0E0 END AS budget_min, CASE session_id % 4 WHEN 1 THEN 985.0E0 END AS budget_max
    FROM {d.ref('interactions_b')} GROUP BY session_id"""


@view("swipes_b")
def likes_i(d):
    return f"""
    SELECT session_id, item_id, max(ts) AS ts
    FROM {d.ref('swipes_b')} WHERE direction = 'right' GROUP BY session_id, item_id"""


# --------------------------------------------------------------------------- catalog text


def _pick(expr: str, n: int, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} % {n} {cases} END"


@view("part")
def catalog_b(d):
    titles = ["Bolero 3-sits soffa svart", "Kelso hörnsoffa i grönt tyg", "Compact armchair dusty rose velvet",
              "Modular sectional sofa off-white", "Inredningsstilar matta med kollektionen", "Skinn fåtölj cognac",
              "Soffbord ek", "2-sits bäddsoffa"]
    descs = ["Skandinavisk design, requires assembly.", "Rustic country look in recycled oak.",
             "Ekologisk bomull; easy delivery", "", "Modern minimalist loft piece with klassisk line"]
    crumbs = ["Hem / Soffor", "Hem / Mattor", "", "Utomhus", "Förvaring"]
    return f"""
    SELECT p_partkey AS item_id, p_partkey % 20 AS source_id,
           {_pick('p_partkey', 8, titles)} || ' ' || p_name AS title,
           {_pick('p_partkey', 5, descs)} AS description,
           {_pick('(p_partkey + p_size)', 5, crumbs)} AS breadcrumb_text,
           {_pick('p_size', 6, ['Läder', 'Ek och stål', 'unknown weave', '  ', 'Chenille', 'wicker'])} AS raw_material,
           {_pick('p_partkey', 7, ['Svart', 'Off-White', 'petrol', '', 'no idea', 'Rost', 'Grön'])} AS raw_color,
           CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN lower(p_type)
                WHEN p_type = 'PROMO' THEN 'Extra Wide' END AS raw_size,
           CASE WHEN p_partkey % 3 = 0 THEN CAST(120 + 3 * p_size AS DOUBLE) END AS width_cm,
           CASE WHEN p_partkey % 4 <> 0 THEN CAST(1 + p_size % 6 AS BIGINT) END AS seat_count,
           CASE WHEN p_partkey % 5 = 1 THEN CAST(p_size * 2 AS DOUBLE) END AS weight_kg,
           CASE WHEN p_partkey % 6 = 2 THEN CAST(p_size * 40 AS DOUBLE) END AS shipping_cost,
           {d.arr("lower(p_type)", "' Modern '")} AS style_tags, p_brand AS brand,
           'https://www.Shop' || CAST(p_partkey % 20 AS VARCHAR(9)) || '.example/p/' ||
             replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR(9)) ||
             CASE WHEN p_partkey % 4 = 0 THEN '?utm_source=x&color=red&sku=' || CAST(p_partkey AS VARCHAR(9))
                  ELSE '' END AS source_url,
           p_retailprice AS price_amount
    FROM {d.ref('part')}"""


@view("part")
def prices_b(d):
    k, c = "CAST(1 + p_partkey % 97 AS VARCHAR(9))", "CAST(100 + (p_partkey * 37) % 900 AS VARCHAR(9))"
    forms = [f"{k} || ' ' || {c} || ' kr'", f"{k} || '.' || {c} || ' kr'", f"{k} || ' ' || {c} || ':-'",
             f"{k} || ' ' || {c} || ',50 SEK'", f"{k} || ',' || {c} || '.25 EUR'",
             f"{k} || ' ' || {c} || ' - ' || {k} || ' ' || {c} || ' kr'"]
    cases = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    return f"""
    SELECT p_partkey AS item_id, CASE p_partkey % 6 {cases} END AS price_text,
           {_pick('p_partkey', 5, ['SEK', 'kr', 'EUR', '', ' sek '])} AS currency,
           CASE WHEN p_partkey % 4 = 0 THEN 'ask' WHEN p_partkey % 4 = 1 THEN '0'
                ELSE CAST(p_partkey AS VARCHAR(9)) || ',90' END AS price_original,
           CAST(900 + p_partkey % 500 AS DOUBLE) AS list_price, p_retailprice AS price_amount
    FROM {d.ref('part')}"""


@view("part")
def dims_b(d):
    w, h, z = ("CAST(120 + 3 * p_size AS VARCHAR(9))", "CAST(60 + p_size AS VARCHAR(9))",
               "CAST(80 + p_partkey % 40 AS VARCHAR(9))")
    return f"""
    SELECT p_partkey AS item_id,
           CASE p_partkey % 5 WHEN 0 THEN 'Bredd: ' || {w} || ' cm' WHEN 1 THEN {w} || '0 mm'
                WHEN 2 THEN '1,' || {h} || ' m' WHEN 3 THEN {w} ELSE 'okänd' END AS dim_text,
           CASE p_partkey % 4 WHEN 0 THEN {w} || ' x ' || {h} || ' x ' || {z} || ' cm'
                WHEN 1 THEN 'Mått ' || {w} || '0×' || {h} || '0×' || {z} || '0 mm'
                WHEN 2 THEN {w} || ' x ' || {h} ELSE '2,1x0,9x0,8 m' END AS triplet_text
    FROM {d.ref('part')}"""


@view("catalog_b", "prices_b")
def feed_b(d):
    return f"""
    SELECT c.item_id, c.source_id,
           CASE WHEN c.item_id % 4 = 0 THEN '' ELSE c.title END AS title,
           CASE WHEN c.item_id % 8 = 0 THEN NULL ELSE c.brand END AS name,
           CASE WHEN c.item_id % 9 = 0 THEN '' ELSE p.price_text END AS price, '' AS price_amount,
           p.currency AS currency,
           CASE WHEN c.item_id % 16 = 0 THEN '' WHEN c.item_id % 3 = 0 THEN NULL ELSE c.source_url END AS url,
           CASE WHEN c.item_id % 16 = 0 THEN '' ELSE c.source_url END AS link,
           CASE WHEN c.item_id % 5 = 0 THEN '' ELSE 'https://cdn.shop.example/' || c.brand || '.jpg' END AS image_url,
           c.brand AS brand, c.description AS description,
           CAST(c.width_cm AS VARCHAR(20)) AS width, c.raw_material AS material, '' AS color, c.raw_color AS colour,
           CASE WHEN c.item_id % 10 = 3 THEN 'Second hand' ELSE '' END AS condition
    FROM {d.ref('catalog_b')} c JOIN {d.ref('prices_b')} p ON p.item_id = c.item_id"""


@view("pages")
def pages_b(d):
    return f"""
    SELECT page_id, url, html, {d.rx('url', '^[a-z]+://([^/]+)', 1)} AS host FROM {d.ref('pages')}"""


@view("pages", "catalog_b")
def urls_b(d):
    """Crawled page urls and catalog source urls, with product-like and listing-like paths."""
    return f"""
    SELECT page_id AS url_id, page_id % 20 AS source_id, url FROM {d.ref('pages')}
    UNION ALL
    SELECT 1000000 + item_id, source_id,
           CASE item_id % 7 WHEN 0 THEN 'https://www.shop1.example/soffor/3-sits-soffor?page=2'
             WHEN 1 THEN replace(source_url, '/p/', '/produkter/') WHEN 2 THEN replace(source_url, '/p/', '/kategori/soffa-')
             WHEN 3 THEN 'http://shop.example/a/b/c/' || CAST(item_id AS VARCHAR(9)) || '.html?variant=1&size=2&variant=3'
             WHEN 4 THEN 'https://shop2.example/products/sofas' ELSE source_url END
    FROM {d.ref('catalog_b')}"""


# --------------------------------------------------------------------------- catalog states


@view("items_b")
def gold_b(d):
    return f"""
    SELECT item_id, 'Gold ' || title AS title, price_amount + 1 AS price_amount, retailer,
           item_id % 2 = 0 AS is_active, CASE WHEN item_id % 5 = 0 THEN 'deck,search' ELSE 'deck' END AS surfaces
    FROM {d.ref('items_b')} WHERE item_id % 3 = 0"""


@view("items_b")
def items_q(d):
    """Items with gaps, classification and image state."""
    return f"""
    SELECT item_id, title, brand, source_id, retailer, is_active, material, color_family, size_class, seat_count, width_cm AS full_width,
           CASE WHEN item_id % 13 = 0 THEN NULL WHEN item_id % 17 = 0 THEN 0.0 ELSE price_amount END AS price_amount,
           CASE WHEN p_size > 40 THEN NULL ELSE width_cm END AS width_cm,
           CASE WHEN p_size > 45 THEN NULL ELSE p_size + 40 END AS height_cm, image_count,
           CASE WHEN item_id % 7 = 0 THEN '  ' ELSE 'https://out.example/' || CAST(item_id AS VARCHAR(9)) END AS outbound_url,
           CASE WHEN item_id % 6 = 0 THEN NULL ELSE type_tag END AS category,
           CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ACCEPT' WHEN 2 THEN 'REJECT' WHEN 3 THEN 'UNCERTAIN' ELSE 'ACCEPT' END AS decision,
           CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id % 8 <> 1 END AS validated, item_id % 3 AS analyzed_images,
           CASE WHEN item_id % 9 = 0 THEN '' ELSE 'img' END AS selected_image,
           CASE item_id % 3 WHEN 0 THEN 'contextual' WHEN 1 THEN 'studio_cutout' END AS scene_type, creative_score,
           CASE WHEN creative_score >= 75 THEN 'green' WHEN creative_score >= 45 THEN 'yellow' ELSE 'red' END AS band,
           CASE item_id % 6 WHEN 0 THEN 'broken' WHEN 1 THEN 'low-resolution' WHEN 2 THEN 'white-background' ELSE '' END AS issue,
           item_id % 5 AS valid_count, (item_id % 10) / 10.0E0 AS completeness,
           CASE WHEN item_id % 2 = 0 THEN 'HTTP' ELSE 'browser' END AS fetch_method, updated_day,
           CASE WHEN item_id % 4 = 0 THEN 'both' WHEN item_id % 4 = 1 THEN 'Indoor' WHEN item_id % 4 = 2 THEN 'outdoor' ELSE 'unknown' END AS environment,
           CASE WHEN seat_count = 2 THEN '2' WHEN seat_count = 3 THEN '3' WHEN seat_count >= 4 AND item_id % 7 <> 0 THEN '4_plus' END AS seat_bucket,
           CASE WHEN item_id % 14 = 0 THEN 'corner_sofa' ELSE '2_seater' END AS sub_category,
           CASE WHEN item_id % 4 = 0 THEN type_tag END AS primary_category, type_tag AS classified_primary_category,
           item_id % 3 = 0 AS modular, seat_count <= 3 AS small_space
    FROM {d.ref('items_b')}"""


@view("items_b")
def controls_b(d):
    return f"""
    SELECT item_id, retailer, item_id % 2 = 0 AS included,
           CASE WHEN item_id % 4 = 0 THEN 'manual' END AS reason FROM {d.ref('items_b')} WHERE item_id % 7 = 0"""


@view("interactions_b")
def votes_b(d):
    return f"""
    SELECT event_id AS vote_id, session_id % 10 AS room, item_id, session_id AS user_id, ts,
           CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS vote
    FROM {d.ref('interactions_b')} WHERE event_type IN ('purchase', 'click', 'error')"""


@view("customer")
def users_b(d):
    return f"""
    SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS display_name FROM {d.ref('customer')}"""


@view("part")
def image_meta_b(d):
    rows = []
    for pos in (1, 2, 3):
        rows.append(f"""
    SELECT p_partkey AS item_id, CAST({pos} AS BIGINT) AS position, CAST(300 + 25 * p_size + {100 * (pos - 1)} AS BIGINT) AS width,
           CAST(400 + 10 * p_size AS BIGINT) AS height, (p_partkey + {pos}) % 9 <> 0 AS valid,
           CAST((p_partkey * {pos} * 7919) % 6000000 AS BIGINT) AS file_size,
           ((p_partkey + {pos * 3}) % 20) / 20.0E0 AS background_ratio, ((p_partkey + {pos * 5}) % 25) / 25.0E0 AS border_ratio,
           ((p_partkey * {pos}) % 10) / 10.0E0 AS near_white_ratio, (p_partkey % 40) / 100.0E0 AS transparent_ratio,
           (p_size % 10) / 10.0E0 AS subject_coverage, ((p_size + {pos}) % 25) / 100.0E0 AS texture_score
    FROM {d.ref('part')} WHERE p_partkey % 4 >= {pos}""")
    return " UNION ALL ".join(rows)


@view("orders")
def extracts_b(d):
    """Extracted pages: source from the order priority, day from the order date."""
    return f"""
    SELECT o_orderpriority AS source_id, {d.day('o_orderdate')} AS dt, o_orderkey AS page_id, o_orderstatus = 'F' AS success,
           (o_custkey % 10) / 10.0E0 AS completeness,
           CASE o_orderkey % 3 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'embedded_json' ELSE 'dom' END AS method,
           o_custkey % 4 <> 0 AS has_description, o_custkey % 3 <> 0 AS has_dimensions
    FROM {d.ref('orders')}"""


@view("orders")
def runs_b(d):
    return f"""
    SELECT o_orderkey AS run_id, o_orderpriority AS source_id, o_orderdate AS started_at,
           CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
           o_custkey % 100 AS fetched, o_custkey % 50 AS candidate_urls, o_custkey % 60 AS success, o_custkey % 7 AS upserted,
           CAST(floor(o_totalprice / 1000) AS BIGINT) AS duration_sec
    FROM {d.ref('orders')}"""


@view("events")
def events_v1_b(d):
    """Typed events; columns go missing by event_id % 13 so that every rule has violations."""
    drop = lambda k, expr: f"CASE WHEN event_id % 13 = {k} THEN NULL ELSE {expr} END"
    return f"""
    SELECT CASE WHEN event_id % 13 = 7 THEN 'x' || CAST(event_id % 90 AS VARCHAR(9)) ELSE 'evt-' || CAST(100000000 + event_id AS VARCHAR(12)) END AS event_id,
           {drop(11, "CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'card_impression_start' ELSE 'card_impression_end' END WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'detail_open' ELSE 'outbound_click' END WHEN 'purchase' THEN 'swipe_right' WHEN 'error' THEN 'swipe_left' ELSE CASE WHEN event_id % 2 = 0 THEN 'deck_response' ELSE 'filters_apply' END END")} AS event_name,
           user_id AS session_id, CASE WHEN event_id % 101 = 0 THEN event_id - 50000 ELSE event_id END AS client_seq,
           ts, ts AS created_at_client, 'web' AS platform,
           {drop(0, d.json_text('props', 'k'))} AS item_id, {drop(1, 'event_id % 50')} AS position_in_deck,
           {drop(2, "'imp-' || CAST(user_id AS VARCHAR(9)) || '-' || CAST(event_id % 4 - event_id % 2 AS VARCHAR(9))")} AS impression_id,
           CAST(floor(value * 100) AS BIGINT) AS visible_ms, {drop(8, "'swiped'")} AS end_reason,
           {drop(3, "'drag'")} AS gesture, 'left' AS direction, {drop(4, "'shop.example'")} AS destination_domain,
           {drop(5, "'run-1'")} AS ranker_run_id, 'v1' AS algorithm_version, {drop(9, "'1,2,3'")} AS served_items,
           {drop(6, "'size=small'")} AS filters_active, {drop(10, "'detail'")} AS surface_name,
           CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'mmr' ELSE 'explore' END AS rank_variant
    FROM {d.ref('events')}"""


# --------------------------------------------------------------------------- texts and labels


@view("documents")
def text_b(d):
    """Documents as items: the first line is the title, the whole text the description."""
    return f"""
    SELECT doc_id AS item_id, source AS source_id, lang, split_part(text, chr(10), 1) AS title, text AS description, n_chars,
           doc_id % 5 <> 0 AS has_images, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS price_amount,
           (n_chars % 10) / 10.0E0 AS completeness_score
    FROM {d.ref('documents')}"""


@view("documents", "labels")
def labels_b(d):
    return f"""
    SELECT l.doc_id AS item_id, l.doc_id AS label_id, t.source AS source_id, t.lang AS predicted, (t.n_chars % 100) / 100.0E0 AS confidence,
           l.quality = 1 AS is_in_category, l.toxic = 0 AS has_images, split_part(t.text, chr(10), 1) AS title, t.text AS description,
           CASE WHEN l.quality = 1 THEN 'accept' WHEN l.doc_id % 3 = 0 THEN 'reject' ELSE 'reclassify' END AS action,
           CASE WHEN l.quality = 1 THEN NULL WHEN l.doc_id % 3 = 1 THEN 'en' WHEN l.doc_id % 3 = 2 THEN 'fr' END AS correct_category,
           CASE l.doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN ' EN ' WHEN 2 THEN 'fr' END AS label_category,
           CASE l.doc_id % 5 WHEN 0 THEN 'in_category' WHEN 1 THEN 'not_category' END AS label_decision
    FROM {d.ref('labels')} l JOIN {d.ref('documents')} t ON t.doc_id = l.doc_id"""


# --------------------------------------------------------------------------- onboarding


@view("customer")
def onboarding_b(d):
    return f"""
    SELECT c_custkey AS session_id,
           CASE c_custkey % 5 WHEN 0 THEN ' Calm_Minimal' WHEN 1 THEN 'warm_organic' WHEN 2 THEN 'bold_eclectic' WHEN 3 THEN 'urban_industrial' END AS scene1,
           CASE WHEN c_custkey % 7 = 0 THEN 'warm_organic' END AS scene2,
           CASE c_custkey % 6 WHEN 0 THEN 'rounded_boucle' WHEN 1 THEN 'low_profile_linen' WHEN 2 THEN 'structured_leather' WHEN 3 THEN 'modular_cloud' END AS vibe1,
           CASE WHEN c_custkey % 4 = 0 THEN 'lt_5k' END AS budget_band, CASE WHEN c_custkey % 3 = 0 THEN '2' END AS seat_count,
           c_custkey % 8 = 0 AS modular_only, c_custkey % 9 = 0 AS kids_pets, c_custkey % 10 = 0 AS small_space
    FROM {d.ref('customer')}"""


@view("customer", "part")
def picks_b(d):
    ids = [f"1 + (c_custkey * 37 + {17 * j}) % (SELECT count(*) FROM {d.ref('part')})" for j in range(4)]
    return f"SELECT c_custkey AS session_id, {d.arr(*ids)} AS picked FROM {d.ref('customer')}"


@view("orders", "lineitem")
def responses_b(d):
    """Served slates: one row per response and position."""
    return f"""
    SELECT o_custkey AS session_id, o_orderkey AS request_id, o_orderdate AS ts, l_partkey AS item_id,
           CASE o_custkey % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'mmr' ELSE 'explore' END AS variant,
           row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position
    FROM {d.ref('lineitem')} JOIN {d.ref('orders')} ON o_orderkey = l_orderkey"""


@view("orders")
def deck_responses_b(d):
    return f"""
    SELECT o_orderkey AS request_id, o_custkey AS session_id, o_orderdate AS ts, CAST(floor(o_totalprice / 100) AS BIGINT) AS latency_ms,
           CASE o_orderstatus WHEN 'F' THEN 'none' WHEN 'O' THEN 'recycled_seen_items' ELSE 'catalog_exhausted' END AS fallback_stage,
           (o_orderkey % 9) / 8.0E0 AS same_family_top8_rate, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 11) / 10.0E0 END AS style_distance_top4_min
    FROM {d.ref('orders')}"""


@view("orders", "lineitem")
def likes_b(d):
    return f"""
    SELECT DISTINCT o_custkey AS session_id, l_partkey AS item_id
    FROM {d.ref('lineitem')} JOIN {d.ref('orders')} ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'"""


# --------------------------------------------------------------------------- targeting and campaigns


@view("customer", "nation", "region")
def profiles_b(d):
    return f"""
    SELECT c_custkey AS session_id, lower(c_mktsegment) AS style, greatest(0.0E0, c_acctbal) AS budget_min, c_acctbal + 2000 AS budget_max,
           CASE c_custkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' END AS size_class, lower(r_name) AS geo_region
    FROM {d.ref('customer')} JOIN {d.ref('nation')} ON n_nationkey = c_nationkey JOIN {d.ref('region')} ON r_regionkey = n_regionkey"""


@view("supplier", "nation", "region")
def segments_b(d):
    return f"""
    SELECT s_suppkey AS segment_id, s_nationkey AS retailer_id,
           CASE s_suppkey % 6 WHEN 0 THEN 'building' WHEN 1 THEN 'Machinery' WHEN 3 THEN 'furniture' WHEN 4 THEN 'household' END AS style1,
           CASE WHEN s_suppkey % 4 = 0 THEN 'automobile' END AS style2,
           CASE WHEN s_suppkey % 3 <> 2 THEN floor(abs(s_acctbal)) END AS budget_min,
           CASE WHEN s_suppkey % 3 = 0 THEN floor(abs(s_acctbal)) + 3000 WHEN s_suppkey % 11 = 1 THEN 10.0E0 END AS budget_max,
           CASE s_suppkey % 7 WHEN 0 THEN 'small' WHEN 1 THEN 'Large' WHEN 2 THEN 'huge' END AS size1,
           CASE WHEN s_suppkey % 5 <> 0 THEN lower(r_name) END AS geo_region
    FROM {d.ref('supplier')} JOIN {d.ref('nation')} ON n_nationkey = s_nationkey JOIN {d.ref('region')} ON r_regionkey = n_regionkey"""


@view("lineitem")
def campaign_daily_b(d):
    """Spend in cents and impressions per campaign and day."""
    return f"""
    SELECT l_suppkey AS campaign_id, {d.day('l_shipdate')} AS dt,
           CAST(sum(CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT)) AS BIGINT) AS spend_cents,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS impressions,
           count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS clicks
    FROM {d.ref('lineitem')} GROUP BY l_suppkey, {d.day('l_shipdate')}"""


@view("supplier", "campaign_daily_b")
def campaigns_b(d):
    return f"""
    SELECT s_suppkey AS campaign_id, s_nationkey AS retailer_id, s_suppkey AS segment_id, s_name AS name,
           CASE s_suppkey % 4 WHEN 0 THEN 'paused' ELSE 'active' END AS status,
           CASE WHEN s_suppkey % 9 <> 0 THEN CAST(floor(abs(s_acctbal) * 80000) AS BIGINT) END AS budget_cents,
           CASE WHEN s_suppkey % 3 <> 0 THEN CAST(floor(abs(s_acctbal) * 300) AS BIGINT) - 1000 END AS budget_daily_cents,
           DATE '1996-01-01' + CAST(s_suppkey % 900 AS INT) AS start_date,
           CASE WHEN s_suppkey % 8 <> 0 THEN DATE '1999-06-01' + CAST((s_suppkey * 37) % 1100 AS INT) ELSE DATE '1995-12-01' END AS end_date,
           CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 7) % 70 END AS frequency_cap,
           CASE s_suppkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'selected' ELSE 'auto' END AS product_mode,
           coalesce(t.spend, 0) AS spent_cents, coalesce(t.impressions, 0) AS impressions, coalesce(t.clicks, 0) AS clicks
    FROM {d.ref('supplier')} LEFT JOIN (SELECT campaign_id, CAST(sum(spend_cents) AS BIGINT) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions,
      CAST(sum(clicks) AS BIGINT) AS clicks FROM {d.ref('campaign_daily_b')} GROUP BY campaign_id) t ON t.campaign_id = s_suppkey"""


@view("lineitem")
def featured_b(d):
    return f"""
    SELECT l_partkey AS item_id, l_suppkey AS campaign_id, l_shipdate AS ts, l_linenumber AS position FROM {d.ref('lineitem')}"""


@view("events")
def funnel_b(d):
    return f"""
    SELECT event_id, ts, user_id AS session_id,
           CASE event_type WHEN 'view' THEN 'intro_shown' WHEN 'click' THEN 'step_viewed' WHEN 'signup' THEN 'step_completed'
             WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'summary_confirmed' ELSE 'swipe_right' END
             ELSE CASE WHEN event_id % 3 = 0 THEN 'skipped' WHEN event_id % 3 = 1 THEN 'swipe_left' ELSE 'deck_response' END END AS event_name,
           CASE WHEN event_id % 4 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'mmr' ELSE 'explore' END END AS rank_variant,
           (event_id % 9) / 8.0E0 AS same_family_top8_rate
    FROM {d.ref('events')}"""


# --------------------------------------------------------------------------- pages with product data


@view("pages")
def pages_x(d):
    """Pages with an appended JSON-LD graph, a page state, or a spec table, by page_id % 3."""
    pid = "CAST(page_id AS VARCHAR(12))"
    ld = (f"""'<script type="application/ld+json">{{"@graph":[{{"@type":"BreadcrumbList","itemListElement":[{{"position":2,"name":"Soffor"}},{{"position":1,"name":"Hem"}}]}},"""
          f"""{{"@type":["Thing","Product"],"name":"Soffa ' || {pid} || '","url":"/p/soffa-' || {pid} || '","image":["/img/a-' || {pid} || '.jpg",{{"contentUrl":"https://cdn.x.example/b.png"}}],"brand":{{"name":"Brand ' || CAST(page_id % 7 AS VARCHAR(9)) || '"}},"""
          f""""sku":"S' || {pid} || '","material":"tyg","width":{{"value":"2.1","unitCode":"MTR"}},"additionalProperty":[{{"name":"Höjd","value":"85 cm"}},{{"name":"Färg","value":"grön"}}],"""
          f""""hasVariant":[{{"sku":"V1","color":"röd","offers":{{"price":"100","availability":"OutOfStock"}}}},{{"sku":"V2","color":"blå","offers":[{{"price":"120"}}]}}],"""
          f""""offers":{{"price":"' || CAST(1000 + page_id AS VARCHAR(12)) || '","priceCurrency":"SEK","availability":"https://schema.org/InStock"}}}}]}}</script>'""")
    state = (f"""'<script id="__NEXT_DATA__" type="application/json">{{"props":{{"page":{{"main":{{"productName":"Stol ' || {pid} || '","currentPrice":' || CAST(500 + page_id AS VARCHAR(12)) || ',"sku":"E' || {pid} || '","gallery":["/g/1.jpg"]}},"""
             f""""list":[{{"name":"Item 1","price":10,"url":"/p/1"}},{{"name":"Item 2","price":20,"url":"/p/2"}},{{"name":"Item 3","price":' || CAST(page_id % 50 AS VARCHAR(9)) || ',"slug":"p3"}}]}}}}}}</script>'""")
    specs = (f"""'<dl><dt>Sitthöjd</dt><dd>' || CAST(40 + page_id % 10 AS VARCHAR(9)) || ' cm</dd><dt>Vikt</dt><dd>' || CAST(page_id % 600 AS VARCHAR(9)) || ' kg</dd></dl>"""
             f"""<table class="spec"><tr><th>Antal sitsar</th><td>' || CAST(1 + page_id % 4 AS VARCHAR(9)) || '</td></tr></table><ul><li>Klädsel: Sammet</li></ul><span class="price">' || CAST(700 + page_id AS VARCHAR(12)) || ' kr</span>'""")
    return f"""
    SELECT page_id, url, CASE WHEN page_id % 21 = 20 THEN replace(replace(html, '<h1>', '<div>'), '</h1>', '</div>') ELSE html END || CASE page_id % 3 WHEN 0 THEN {ld} WHEN 1 THEN {state} ELSE {specs} END AS html FROM {d.ref('pages')}"""
