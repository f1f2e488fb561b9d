"""Page extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import extract as E
from larkspur.plans.q_normalize import sql_unescape
from larkspur.plans.registry import query

_BASE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query("ext_page_signals", r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), '') AS title,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS h1, 'none' AS canonical_url, 'none' AS og_type,
    CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS jsonld_blocks, CAST(len(regexp_extract_all(html, '(?is)<script[^>]*>')) AS BIGINT) AS scripts FROM pages_x""", "pages_x")
def ext_page_signals(t):
    s = E.page_signals(t.pages_x)
    return s.select("page_id", "title", "h1", F.coalesce("canonical_url", F.lit("none")).alias("canonical_url"),
                    F.coalesce("og_type", F.lit("none")).alias("og_type"), "jsonld_blocks", "scripts")


@query("ext_embedded_json", """SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS ld_blocks, CAST(CASE WHEN page_id % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS embedded_blocks,
    CASE WHEN page_id % 3 = 1 THEN 'props' ELSE '' END AS top_keys FROM pages""")
def ext_embedded_json(t):
    return E.embedded_json(t.pages_x).withColumn("top_keys", F.array_join("top_keys", "|"))


@query("ext_jsonld_product", f"""SELECT page_id, 'Soffa ' || page_id AS title, '/p/soffa-' || page_id AS url, '/img/a-' || page_id || '.jpg|https://cdn.x.example/b.png' AS images, 'Brand ' || page_id % 7 AS brand,
    CAST(1000 + page_id AS VARCHAR) AS price_raw, 'SEK' AS currency, 'tyg' AS material, 'grön' AS color, 210.0::DOUBLE AS width_cm, 85.0::DOUBLE AS height_cm, 'S' || page_id AS sku, 'in_stock' AS availability FROM pages WHERE page_id % 3 = 0""")
def ext_jsonld_product(t):
    found = E.jsonld_product(t.pages_x).where(F.col("product").isNotNull())
    p = found.select("page_id", E.jsonld_fields(F.col("product")).alias("p"))
    return p.select("page_id", "p.title", "p.url", F.array_join("p.images", "|").alias("images"), "p.brand", "p.price_raw", "p.currency", "p.material",
                    "p.color", "p.width_cm", "p.height_cm", F.col("p.identity.sku").alias("sku"), "p.availability")


@query("ext_embedded_product", """SELECT page_id, 5.5::DOUBLE AS node_score, 'Stol ' || page_id AS title, CAST(500 + page_id AS VARCHAR) AS price_raw, 'E' || page_id AS sku, '/g/1.jpg' AS images FROM pages WHERE page_id % 3 = 1""")
def ext_embedded_product(t):
    found = E.embedded_product(t.pages_x).where(F.col("node").isNotNull())
    p = found.select("page_id", "node_score", E.embedded_fields(F.col("node")).alias("p"))
    return p.select("page_id", "node_score", "p.title", "p.price_raw", F.col("p.identity.sku").alias("sku"), F.array_join("p.images", "|").alias("images"))


@query("ext_state_products", """SELECT page_id, pos AS position, 'Item ' || (pos + 1) AS title, CASE pos WHEN 0 THEN '10' WHEN 1 THEN '20' ELSE CAST(page_id % 50 AS VARCHAR) END AS price_raw
    FROM pages, (VALUES (0), (1), (2)) v(pos) WHERE page_id % 3 = 1""")
def ext_state_products(t):
    return E.state_products(t.pages_x).select("page_id", "position", "title", "price_raw")


@query("ext_breadcrumbs", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Hem > Soffor' ELSE '' END AS breadcrumbs FROM pages")
def ext_breadcrumbs(t):
    return E.breadcrumbs(t.pages_x).withColumn("breadcrumbs", F.array_join("breadcrumbs", " > "))


@query("ext_variants", """SELECT page_id, pos AS position, CASE pos WHEN 0 THEN 'V1' ELSE 'V2' END AS sku, CASE pos WHEN 0 THEN 'röd' ELSE 'blå' END AS color, CASE pos WHEN 0 THEN 100.0 ELSE 120.0 END::DOUBLE AS price, pos = 1 AS available
    FROM pages, (VALUES (0), (1)) v(pos) WHERE page_id % 3 = 0""")
def ext_variants(t):
    return E.variants(E.jsonld_product(t.pages_x)).select("page_id", "position", "sku", "color", "price", "available")


@query("ext_field_map", "SELECT page_id, 'Stol ' || page_id AS title, CAST(500 + page_id AS VARCHAR) AS price_raw, '/g/1.jpg' AS image FROM pages WHERE page_id % 3 = 1")
def ext_field_map(t):
    states = E.with_blocks(t.pages_x).where(F.size("embedded") > 0).withColumn("v", F.element_at("embedded", 1))
    return E.apply_field_map(states, "v", {
        "title": ["$.props.page.main.name", "$.props.page.main.productName"], "price_raw": ["$.props.page.main.price", "$.props.page.main.currentPrice"],
        "image": ["$.props.page.main.gallery[*]"]}).drop("url")


@query("ext_spec_pairs", """WITH p AS (SELECT page_id, unnest([{'k': 'Sitthöjd', 'v': (40 + page_id % 10) || ' cm'}, {'k': 'Vikt', 'v': (page_id % 600) || ' kg'}, {'k': 'Antal sitsar', 'v': CAST(1 + page_id % 4 AS VARCHAR)}, {'k': 'Klädsel', 'v': 'Sammet'}]) AS e
    FROM pages WHERE page_id % 3 = 2) SELECT page_id, e.k AS key, e.v AS value FROM p""")
def ext_spec_pairs(t):
    return E.spec_pairs(t.pages_x).select("page_id", "key", "value")


@query("ext_rich_specs", """SELECT page_id, CAST(40 + page_id % 10 AS DOUBLE) AS seat_height_cm, CAST(1 + page_id % 4 AS DOUBLE) AS seat_count,
    CASE WHEN page_id % 600 > 0 AND page_id % 600 < 500 THEN CAST(page_id % 600 AS DOUBLE) END AS weight_kg, 'Sammet' AS cover_material FROM pages WHERE page_id % 3 = 2""")
def ext_rich_specs(t):
    return E.rich_specs(E.spec_pairs(t.pages_x)).select("page_id", "seat_height_cm", "seat_count", "weight_kg", "cover_material")


_H1 = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


_DOM_TITLE = f"nullif({sql_unescape(_H1)}, '')"
# a description is the first paragraph of 40 characters or more
_PARAGRAPH = "trim(regexp_replace(regexp_replace(regexp_replace(x, '(?s)</p>.*|</article>.*', ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_DESCRIBED = f"len(list_filter(string_split(regexp_extract(html, '(?s)<article>.*', 0), '<p>')[2:], lambda x: length({sql_unescape(_PARAGRAPH)}) >= 40)) > 0"


@query("ext_cascade", f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'embedded_json' ELSE 'dom' END AS method,
    CAST(CASE page_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 500 ELSE 700 END + page_id AS DOUBLE) AS price_amount,
    CASE page_id % 3 WHEN 0 THEN 'Soffa ' || page_id WHEN 1 THEN 'Stol ' || page_id ELSE {_DOM_TITLE} END AS title, CASE page_id % 3 WHEN 0 THEN 'SEK' WHEN 2 THEN 'SEK' END AS price_currency,
    CASE WHEN page_id % 3 = 0 THEN 'Brand ' || page_id % 7 END AS brand, CASE WHEN page_id % 3 = 0 THEN 210.0::DOUBLE END AS width_cm, CASE WHEN page_id % 3 = 0 THEN 85.0::DOUBLE END AS height_cm,
    CASE page_id % 3 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'unknown' END AS availability, floor(CASE page_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 10 ELSE 9 + CASE WHEN {_DESCRIBED} THEN 2 ELSE 0 END END / 17.0::DOUBLE * 10000 + 0.5) / 10000 AS completeness
    FROM pages WHERE page_id % 3 <> 2 OR (page_id % 21 <> 20 AND {_DOM_TITLE} IS NOT NULL)""")
def ext_cascade(t):
    return E.extract_products(t.pages_x).select("page_id", "method", "price_amount", "title", "price_currency", "brand", "width_cm", "height_cm", "availability",
                                                  (F.floor(F.col("completeness") * 1e4 + 0.5) / 1e4).alias("completeness"))


@query("ext_page_links", rf"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']+)["'']', 1)) AS h FROM pages_b)
    SELECT DISTINCT page_id, regexp_replace(CASE WHEN starts_with(h, '//') THEN 'https:' || h WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '/') THEN {_BASE} || h
      ELSE coalesce(nullif(regexp_extract(url, '^([^:/?#]+://[^/?#]*[^?#]*/)', 1), ''), {_BASE} || '/') || h END, '#.*$', '') AS link, 'anchor' AS kind FROM l""", "pages_b")
def ext_page_links(t):
    return E.page_links(t.pages_b)


def _shells(t):
    """Pages with what script shells and block pages hold: an empty root, a notice for browsers without scripts, a captcha."""
    add = lambda cond, text: F.when(F.expr(cond), text).otherwise("")
    return t.pages_b.withColumn("html", F.concat("html", add("page_id % 6 = 4", '<div id="root"> </div>'), add("page_id % 10 = 3", "<noscript>Please enable JavaScript</noscript>"),
                                                 add("page_id % 15 = 7", "<script src='/px-captcha.js'></script>")))


@query("ext_render_flags", rf"""WITH b AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<title\b.*?</title>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body, {_H1} AS h1 FROM pages_b),
    f AS (SELECT page_id, octet_length(encode(body)) < 2048 AS low_text, length(h1) < 8 AS no_product_signal, page_id % 6 = 4 AS empty_root, page_id % 10 = 3 AS noscript_notice, page_id % 15 = 7 AS blocked FROM b)
    SELECT page_id, blocked, low_text, empty_root, noscript_notice, no_product_signal, CAST(low_text::INT + empty_root::INT + noscript_notice::INT + no_product_signal::INT AS BIGINT) AS score,
      blocked OR low_text::INT + empty_root::INT + noscript_notice::INT + no_product_signal::INT >= 2 AS needs_render FROM f""", "pages_b")
def ext_render_flags(t):
    return E.render_flags(_shells(t)).select("page_id", "blocked", "low_text", "empty_root", "noscript_notice", "no_product_signal", "score", "needs_render")


@query("ext_facets", """SELECT page_id, (40 + page_id % 10) || ' cm' AS seat_height, (page_id % 600) || ' kg' AS weight, CAST(1 + page_id % 4 AS VARCHAR) AS seats, 'Sammet' AS cover, 4::BIGINT AS keys FROM pages WHERE page_id % 3 = 2""")
def ext_facets(t):
    f = E.facets(E.spec_pairs(t.pages_x))
    return f.select("page_id", F.col("facets")["Sitthöjd"].alias("seat_height"), F.col("facets")["Vikt"].alias("weight"), F.col("facets")["Antal sitsar"].alias("seats"),
                    F.col("facets")["Klädsel"].alias("cover"), F.size(F.map_keys("facets")).cast("bigint").alias("keys"))


@query("ext_failures", f"""SELECT page_id, 'parse' AS failure_type, 0::BIGINT AS jsonld_blocks FROM pages WHERE page_id % 3 = 2 AND (page_id % 21 = 20 OR {_DOM_TITLE} IS NULL)""")
def ext_failures(t):
    return E.extraction_failures(t.pages_x, E.extract_products(t.pages_x)).select("page_id", "failure_type", "jsonld_blocks")
