"""URL and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import url as U
from larkspur.functions import url_type as UT
from larkspur.operators import normalize as N
from larkspur.operators import urls as O
from larkspur.plans.q_normalize import sql_any
from larkspur.plans.registry import query
from larkspur.sources import feeds

_V = "urls_b"
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z]+):', 1))"
_ROOTED = f"coalesce(nullif({_PATH}, ''), '/')"
_KEY = f"({_SCHEME} || '://' || {_HOST} || CASE WHEN length({_ROOTED}) > 1 THEN rtrim({_ROOTED}, '/') ELSE {_ROOTED} END)"
_PAIRS = f"list_filter(string_split({_QUERY}, '&'), lambda p: regexp_matches(p, '^[^=]*=.+$'))"


@query("url_canonical", f"""WITH u AS (SELECT url_id, url, list_filter({_PAIRS}, lambda p: NOT regexp_matches(lower(p), '^(utm_(source|medium|campaign|content|term)|fbclid|gclid)=')) AS ps FROM urls_b),
    k AS (SELECT *, list_transform(ps, lambda p: split_part(p, '=', 1)) AS ks FROM u),
    o AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(ps, lambda p, i: printf('%03d%03d', list_position(ks, ks[i]), i) || p)), lambda p: substr(p, 7)), '&') AS q FROM k)
    SELECT url_id, {_SCHEME} || '://' || {_HOST} || {_ROOTED} || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM o""", _V)
def url_canonical(t):
    return t.urls_b.select("url_id", U.canonical_url(F.col("url")).alias("canonical"))


@query("url_domain_counts", f"SELECT regexp_replace({_HOST}, '^www\\.', '') AS domain, count(*) AS urls FROM urls_b GROUP BY 1", _V)
def url_domain_counts(t):
    return O.domain_counts(t.urls_b)


@query("url_seed_parts", f"""WITH s AS (SELECT url_id, {_SCHEME} AS sc, {_HOST} AS h, {_ROOTED} AS p,
      list_filter(string_split({_ROOTED}, '/'), lambda x: x <> '') AS seg FROM urls_b),
    q AS (SELECT *, list_filter(seg, lambda x: lower(x) IN ('p', 'product', 'produkt', 'products', 'produkter')) AS prod FROM s)
    SELECT url_id, rtrim(sc || '://' || h || p, '/') AS normalized, h AS domain, sc || '://' || h AS base_url,
      CASE WHEN p <> '/' THEN p ELSE '' END AS seed_path,
      CASE WHEN len(seg) = 0 THEN '' WHEN len(prod) > 0 THEN '/' || prod[1] || '/' ELSE '/' || seg[-1] END AS seed_pattern FROM q""", _V)
def url_seed_parts(t):
    return t.urls_b.select("url_id", U.source_url_parts(F.col("url")).alias("p")).select("url_id", "p.*")


@query("url_signature", f"""WITH n AS (SELECT url_id, {_KEY} AS k, list_sort(list_distinct(list_filter(list_transform({_PAIRS}, lambda p: lower(split_part(p, '=', 1))),
      lambda x: x IN ('sku', 'variant', 'size', 'color')))) AS names FROM urls_b)
    SELECT url_id, k || CASE WHEN len(names) > 0 THEN '?' || array_to_string(names, '&') ELSE '' END AS signature FROM n""", _V)
def url_signature(t):
    return t.urls_b.select("url_id", U.url_signature(F.col("url")).alias("signature"))


@query("set_dedupe_urls", f"SELECT {_KEY} AS url_key, min_by(url, url_id) AS url, count(*) AS copies FROM urls_b GROUP BY 1", _V)
def set_dedupe_urls(t):
    return O.dedupe_urls(t.urls_b, "url_id")


def _b(cond: str, w: str) -> str:
    return f"(CASE WHEN {cond} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END)"


def _in(col: str, values) -> str:
    return f"{col} IN ({', '.join(repr(v) for v in values)})"


_LISTED = {k: _in("last", v) for k, v in UT.LISTING_HANDLES.items()}
_TYPE_SQL = f"""
  seg AS (SELECT *, lower({_PATH}) AS p, lower({_QUERY}) AS q, list_filter(string_split(lower({_PATH}), '/'), lambda x: x <> '') AS s FROM urls_b),
  lst AS (SELECT *, coalesce(s[-1], '') AS last, len(s) AS depth FROM seg),
  sig AS (SELECT *, length(last) - length(replace(last, '-', '')) AS hy, regexp_matches(last, '{UT.SEAT_SLUG}') AS seat,
     ({_in('last', UT.GENERIC_SLUGS)} OR regexp_matches(last, '{UT.SEAT_SLUG}') OR regexp_matches(last, '{UT.PLURAL_SLUG}')) AS gen,
     regexp_matches(p, '/products/[^/]+/?$') AS h1, regexp_matches(p, '/produkter/[^/]+/?$') AS h2,
     {' + '.join(f"CAST(contains(p, '{x}') AS INT)" for x in UT.CATEGORY_TOKENS)} AS hits0 FROM lst),
  prod AS (SELECT *, hits0 - CASE WHEN hits0 > 0 AND (h1 OR h2) THEN 1 ELSE 0 END AS hits,
     {_b(sql_any('p', UT.PRODUCT_TOKENS), '0.55')} + {_b("regexp_matches(p, '/p/[a-z0-9]')", '0.6')}
     + {_b(f"h1 AND NOT {_LISTED['products']}", '0.6')} + {_b(f"h2 AND NOT {_LISTED['produkter']}", '0.6')}
     + {_b("regexp_matches(p, '/p-[a-z][0-9]{4,}')", '0.6')} + {_b("regexp_matches(p, '-p[0-9]+(-v[0-9]+)?([^a-z0-9_]|$)')", '0.65')}
     + {_b("regexp_matches(p, '/[0-9]{6,}(-[0-9]+)?/?$')", '0.55')} + {_b("regexp_matches(p, '[-/][a-z]{2,3}[0-9]{4,}')", '0.25')}
     + {_b(f"last <> '' AND NOT gen AND regexp_matches(last, '{UT.SINGULAR_SLUG}') AND (hy >= 1 OR length(last) >= 10)", '0.45')}
     + {_b("last <> '' AND NOT gen AND hy >= 2 AND length(last) >= 12", '0.35')}
     + CASE WHEN depth >= 4 THEN 0.15::DOUBLE WHEN depth >= 3 AND last <> '' AND NOT gen THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
     + {_b("regexp_matches(p, '/[^/]+[.]html?$') AND NOT ends_with(p, '/index.html') AND depth >= 4", '0.45')} AS strength FROM sig),
  raw AS (SELECT *, 0.3::DOUBLE + strength
     - {_b(f"h1 AND {_LISTED['products']}", '0.25')} - {_b(f"h2 AND {_LISTED['produkter']}", '0.25')}
     - CASE WHEN strength >= 0.4 THEN 0.15::DOUBLE ELSE 0.35::DOUBLE END * least(hits, 2)
     - CASE WHEN last = '' THEN 0.0::DOUBLE WHEN seat THEN 0.45::DOUBLE WHEN gen THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
     - {_b(sql_any('p', UT.UTILITY_TOKENS), '0.5')}
     - {_b(sql_any('q', ['page=', 'sort=', 'filter', 'q=', 'search=', 'brand=', 'campaign']), '0.35')}
     + {_b("contains(q, 'variant=') AND h1", '0.15')} - {_b("regexp_matches(lower(url), '[?&](page|p)=[0-9]+')", '0.4')}
     - {_b("contains(p, '/sida.html')", '0.6')} - {_b('depth <= 2 AND strength < 0.4', '0.15')}
     - {_b("ends_with(p, '/index.html')", '0.35')} AS score FROM prod),
  clamped AS (SELECT *, CASE WHEN regexp_matches(p, '{UT.STATIC_EXT}') OR p IN ('', '/') THEN 0.0::DOUBLE
     ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)) END AS confidence FROM raw),
  typed AS (SELECT *, CASE WHEN regexp_matches(p, '{UT.STATIC_EXT}') THEN 'non_product' WHEN p IN ('', '/') THEN 'homepage'
     WHEN confidence >= 0.65 THEN 'product' WHEN confidence <= 0.25 THEN 'category' ELSE 'unknown' END AS hint FROM clamped)"""


def _r4(c: str) -> str:
    return f"floor(({c}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


@query("cls_url_type", f"WITH {_TYPE_SQL} SELECT url_id, {_r4('confidence')} AS confidence, hint FROM typed", _V)
def cls_url_type(t):
    return O.with_url_type(t.urls_b).select("url_id", (F.floor(F.col("confidence") * 1e4 + 0.5) / 1e4).alias("confidence"), "hint")


@query("flt_product_candidates", f"""WITH {_TYPE_SQL} SELECT url_id, hint FROM typed
    WHERE p NOT IN ('', '/') AND NOT regexp_matches(p, '{UT.GATE_STATIC}')
      AND len(list_filter({_PAIRS}, lambda x: lower(split_part(x, '=', 1)) NOT IN ('variant', 'sku', 'size', 'color'))) = 0
      AND NOT (regexp_matches(p, '{UT.GATE_CATEGORY}') AND NOT regexp_matches(p, '{UT.GATE_PRODUCT}') AND confidence < 0.82)
      AND ((hint = 'product' AND confidence >= 0.58) OR confidence >= 0.82 OR regexp_matches(p, '{UT.GATE_PRODUCT}'))""", _V)
def flt_product_candidates(t):
    return O.product_candidates(t.urls_b).select("url_id", "hint")


@query("flt_allowlisted_urls", f"""SELECT url_id FROM urls_b WHERE source_id % 4 = 3 OR ({_SCHEME} = 'https'
      AND (source_id % 4 <> 1 OR {_HOST} IN (SELECT 'www.shop' || x || '.example' FROM range(0, 10) r(x)))
      AND (source_id % 4 <> 2 OR starts_with({_PATH}, '/p/') OR starts_with({_PATH}, '/en/') OR contains(lower({_PATH}), 'sitemap')))""", _V)
def flt_allowlisted_urls(t):
    hosts = "transform(sequence(0, 9), x -> concat('www.shop', x, '.example'))"
    policies = t.urls_b.select("source_id").distinct().selectExpr(
        "source_id",
        f"CASE source_id % 4 WHEN 1 THEN {hosts} WHEN 3 THEN null ELSE array() END AS domains",
        "CASE source_id % 4 WHEN 2 THEN array('/p/', '/en/') WHEN 3 THEN null ELSE array() END AS path_prefixes")
    return O.allowlisted_urls(t.urls_b, policies).select("url_id")


@query("url_outbound_utm", f"""SELECT url_id, CASE WHEN {_SCHEME} = 'https' THEN 'https://' || {_HOST} || {_ROOTED} || '?' ||
      array_to_string(list_concat(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_source=')),
        ['utm_source=discovery', 'utm_medium=referral', 'utm_campaign=beta', 'utm_content=' || CAST(url_id AS VARCHAR)]), '&') ||
      CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END END AS outbound FROM urls_b""", _V)
def url_outbound_utm(t):
    return t.urls_b.select("url_id", U.append_utm(F.col("url"), F.col("url_id").cast("string")).alias("outbound"))


@query("url_list_audit", f"""WITH n AS (SELECT CASE WHEN {_HOST} <> '' THEN {_KEY} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END END AS u FROM urls_b
      UNION ALL SELECT CASE WHEN {_HOST} <> '' THEN {_KEY} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END END FROM urls_b WHERE url_id % 3 = 0
      UNION ALL SELECT NULL FROM urls_b WHERE url_id % 7 = 0)
    SELECT count(*) AS total, count(u) AS valid, count(*) - count(u) AS invalid, count(DISTINCT u) AS unique_urls,
      count(u) - count(DISTINCT u) AS duplicates FROM n""", _V)
def url_list_audit(t):
    u = t.urls_b
    listed = u.select("url").unionByName(u.where("url_id % 3 = 0").select(F.concat(F.lit(" "), "url", F.lit(",")).alias("url")))
    return O.audit_urls(listed.unionByName(u.where("url_id % 7 = 0").select(F.lit(");").alias("url"))))


_RANK = f"""confidence + {_b("hint = 'product'", '0.35')} + least(depth, 6) * 0.03::DOUBLE
    + {_b(sql_any('lower(url)', 'soffa soffor sofa sofas hornsoffa hörnsoffa divansoffa divan fatolj fåtölj'.split()), '0.25')}
    - {_b("contains(url, '?') AND hint <> 'product'", '0.25')}
    - {_b(sql_any('q', ['page=', 'sort=', 'filter', 'q=', 'search=', 'brand=']), '0.2')}
    - {_b(sql_any('p', ['/kampanj', '/campaign', '/kundservice', '/butiker', '/inspiration']), '0.35')}
    - {_b("ends_with(p, '/index.html')", '0.25')} - {_b("contains(p, '/sida.html')", '0.7')}
    - {_b(f"depth = 2 AND s[1] = 'products' AND {_in('s[2]', UT.LISTING_HANDLES['products'])}", '0.5')}
    - {_b(sql_any('p', ['/article/', '/articles/', '/inspiration', '/blog', '/guide', '/info/']) + " AND hint <> 'product'", '0.3')}
    + {_b("ends_with(p, '.html') AND NOT ends_with(p, '/index.html') AND depth >= 4", '0.3')}"""


@query("url_rank_candidates", f"""WITH {_TYPE_SQL}, ranked AS (SELECT *, {_r4(_RANK)} AS rank_score, {_HOST} AS host, {_KEY} AS k FROM typed),
    best AS (SELECT *, row_number() OVER (PARTITION BY host, k ORDER BY rank_score DESC, url DESC) AS c FROM ranked),
    top AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank_score DESC, k) AS rank FROM best WHERE c = 1)
    SELECT host, url, hint, rank_score, rank FROM top WHERE rank <= 5""", _V)
def url_rank_candidates(t):
    return O.rank_candidates(t.urls_b, 5).select(
        "host", "url", "hint", "rank_score", F.col("rank").cast("bigint").alias("rank"))


@query("url_normalize_images", r"""
    WITH c AS (SELECT page_id, host, unnest(['//cdn.' || host || '/a/' || page_id || '.jpg', '/img/' || page_id || '-large?w=800', 'thumb-', 'https://' || host || '/p/thing-' || page_id,
        '/img/' || page_id || '-large?w=800']) AS u, unnest([1, 2, 3, 4, 5]) AS pos FROM pages_b WHERE page_id % 2 = 0
      UNION ALL SELECT page_id, host, unnest(['/p/longer-' || page_id, 'https://' || host || '/kategori/soffor']), unnest([1, 2]) FROM pages_b WHERE page_id % 2 = 1),
    a AS (SELECT page_id, min(pos) AS pos, CASE WHEN starts_with(u, '//') THEN 'https:' || u WHEN starts_with(u, 'http') THEN u ELSE 'https://' || host || '/' || ltrim(u, '/') END AS u
      FROM c WHERE u <> 'thumb-' GROUP BY 1, 3)
    SELECT page_id, string_agg(u, ' ' ORDER BY pos) FILTER (WHERE page_id % 2 = 1 OR contains(u, '.jpg') OR contains(u, 'w=')) AS images FROM a GROUP BY page_id""", "pages_b")
def url_normalize_images(t):
    even = ("array(concat('//cdn.', host, '/a/', page_id, '.jpg'), concat('/img/', page_id, '-large?w=800'), 'thumb-', "
            "concat('https://', host, '/p/thing-', page_id), concat('/img/', page_id, '-large?w=800'))")
    odd = "array(concat('/p/longer-', page_id), concat('https://', host, '/kategori/soffor'))"
    raw = t.pages_b.selectExpr("page_id", "host", f"IF(page_id % 2 = 0, {even}, {odd}) AS arr")
    return raw.select("page_id", F.array_join(
        U.normalize_images(F.col("arr"), F.concat(F.lit("https://"), "host", F.lit("/"))), " ").alias("images"))


# ---- sources ---------------------------------------------------------------------------


@query("flt_url_category", "SELECT page_id FROM pages WHERE contains(lower(url), '/en/') OR contains(lower(url), 'blog.')")
def flt_url_category(t):
    return O.category_filter(t.pages, [" /EN/ ", "", "blog."]).select("page_id")


@query("src_pages", """SELECT host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages_b GROUP BY host""", "pages_b")
def src_pages(t):
    pages = feeds.read_pages(t.spark, f"{t.sf_dir}/pages.parquet")
    return pages.groupBy(U.host(F.col("url")).alias("host")).agg(
        F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query("src_items_by_ids", "SELECT item_id, title, price_amount FROM items_b WHERE item_id IN (3, 14, 15, 92, 65, 35, 1000000)", "items_b")
def src_items_by_ids(t):
    return feeds.items_by_ids(t.items_b, [3, 14, 15, 92, 65, 35, 1000000]).select("item_id", "title", "price_amount")


@query("top_recent_items", "SELECT item_id, title, updated_day FROM items_b ORDER BY updated_day DESC, item_id DESC LIMIT 50", "items_b")
def top_recent_items(t):
    return feeds.recent_items(t.items_b, 50).select("item_id", "title", "updated_day")


def _written(t, name: str, write) -> str:
    """Folder of a feed file derived from the item table for a source query."""
    from larkspur.session import unique_dir
    path = unique_dir(t.spark, name)
    write(path)
    return path


@query("src_feed_csv", """SELECT item_id, title, price, currency, brand FROM (
    SELECT CAST(item_id AS VARCHAR) AS item_id, coalesce(nullif(title, ''), name, '') AS title, coalesce(nullif(price, ''), '0') AS price,
      trim(coalesce(nullif(currency, ''), 'SEK')) AS currency, brand, coalesce(nullif(url, ''), nullif(link, ''), '') AS u FROM feed_b) WHERE title <> '' OR u <> ''""", "feed_b")
def src_feed_csv(t):
    path = _written(t, "feed_csv", lambda p: t.feed_b.write.mode("overwrite").option("header", True).option("escape", '"').csv(p))
    raw = feeds.read_feed_csv(t.spark, path, t.feed_b.columns)
    return N.map_feed_columns(raw, keep=("item_id",)).select("item_id", "title", "price", "currency", "brand")


@query("src_feed_json", """SELECT title, count(*) AS items FROM feed_b WHERE title <> '' GROUP BY title""", "feed_b")
def src_feed_json(t):
    """One JSON document per source, its rows under `items` or `products`."""
    rows = t.feed_b.where("title <> ''").selectExpr(
        "source_id", "item_id % 50 AS part", "struct(title, price, currency, url, brand) AS r")
    docs = rows.groupBy("source_id", "part").agg(F.collect_list("r").alias("rows"))
    docs = docs.selectExpr("if(part % 2 = 0, rows, null) AS items", "if(part % 2 = 1, rows, null) AS products")
    path = _written(t, "feed_json", lambda p: docs.write.mode("overwrite").json(p))
    feed = N.map_feed_columns(feeds.read_feed_json(t.spark, path, multi_line=False))
    return feed.groupBy("title").agg(F.count("*").alias("items"))


@query("src_sitemap", """SELECT kind, count(*) AS urls, count(DISTINCT url) AS distinct_urls FROM (
      SELECT url, 'url' AS kind FROM urls_b UNION ALL SELECT 'https://' || host || '/sitemap.xml', 'sitemap' FROM pages_b) GROUP BY kind""", "urls_b pages_b")
def src_sitemap(t):
    """A urlset, an index and a plain list written from the url table, read back as one folder."""
    u = t.urls_b
    def write(p):
        (u.where("url_id % 2 = 0").select(F.col("url").alias("loc")).write.mode("overwrite").format("xml")
         .option("rootTag", "urlset").option("rowTag", "url").save(f"{p}/set"))
        (t.pages_b.select(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("loc")).write.mode("overwrite")
         .format("xml").option("rootTag", "sitemapindex").option("rowTag", "sitemap").save(f"{p}/index"))
        u.where("url_id % 2 = 1").select("url").write.mode("overwrite").text(f"{p}/list")
    path = _written(t, "sitemap", write)
    return feeds.read_sitemap(t.spark, f"{path}/*").groupBy("kind").agg(
        F.count("*").alias("urls"), F.count_distinct("url").alias("distinct_urls"))
