"""Normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import hashing as H
from larkspur.functions import lexicons as L
from larkspur.functions import price as P
from larkspur.functions import text as T
from larkspur.functions.numbers import finite
from larkspur.functions.staging import spread_rows
from larkspur.operators import normalize as N
from larkspur.plans.registry import query

BOUNDS = (920, 940, 960, 980)


# ---- oracle text helpers (DuckDB) ------------------------------------------------------


def sql_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def sql_first(text: str, lexicon, word: bool = False) -> str:
    fix = (lambda t: f" {t.replace('-', ' ')} ") if word else (lambda t: t)
    return "CASE " + " ".join(
        f"WHEN {sql_any(text, [fix(t) for t in terms])} THEN '{k}'" for k, terms in lexicon.items()) + " END"


def sql_padded(c: str) -> str:
    return rf"(' ' || regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ')"


def sql_blob(*cols: str) -> str:
    return f"trim(regexp_replace(lower(concat_ws(' ', {', '.join(cols)})), '[^a-z0-9åäö]+', ' ', 'g'))"


def sql_token(c: str) -> str:
    return f"nullif(lower(trim({c})), '')"


def sql_canon(c: str, lexicon, fallback: str) -> str:
    return (f"CASE WHEN {sql_token(c)} IS NOT NULL THEN "
            f"coalesce({sql_first(sql_token(c), lexicon)}, '{fallback}') END")


def sql_price(c: str) -> str:
    t = f"regexp_replace(regexp_replace(replace(trim(regexp_extract({c}, '-?\\d[\\d\\s.,]*')), ' ', ''), '^-+', ''), '^[.,]+|[.,]+$', '', 'g')"
    return f"""(SELECT CASE WHEN v > 0 AND NOT neg THEN v END FROM (SELECT regexp_matches(regexp_extract({c}, '-?\\d[\\d\\s.,]*'), '^-') AS neg, TRY_CAST(
      CASE WHEN contains(t, ',') AND contains(t, '.') THEN
             CASE WHEN regexp_matches(t, ',[^.]*$') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END
           WHEN regexp_matches(t, '^[^,]*,[^,]*$') THEN
             CASE WHEN regexp_matches(t, '^\\d+,\\d{{3}}$') THEN replace(t, ',', '') ELSE replace(t, ',', '.') END
           WHEN regexp_matches(t, '^\\d+\\.\\d{{3}}$') THEN replace(t, '.', '')
           WHEN contains(t, ',') THEN replace(t, ',', '')
           WHEN regexp_matches(t, '\\..*\\.') THEN replace(t, '.', '')
           ELSE t END AS DOUBLE) AS v FROM (SELECT {t} AS t) q1) q2)"""


# ---- queries ---------------------------------------------------------------------------


@query("nrm_price_amount", f"SELECT item_id, price_text, {sql_price('price_text')} AS price FROM prices_b", "prices_b")
def nrm_price_amount(t):
    return t.prices_b.select("item_id", "price_text", P.price_amount(F.col("price_text")).alias("price"))


@query("nrm_money_sv", r"""
    WITH s AS (SELECT item_id, upper(regexp_extract(price_text, '(?i)\b(sek|kr|kronor|eur|usd)\b', 1)) AS marker,
        regexp_replace(replace(price_text, ':-', ''), '[^0-9,.\-]', '', 'g') AS digits FROM prices_b),
    d AS (SELECT * FROM s),
    a AS (SELECT *, TRY_CAST(CASE WHEN contains(digits, ',') THEN replace(replace(digits, '.', ''), ',', '.')
        WHEN regexp_matches(digits, '^\d+\.\d{3}$') THEN replace(digits, '.', '') ELSE digits END AS DOUBLE) AS amount FROM d)
    SELECT item_id, amount, CASE WHEN marker IN ('SEK', 'KR', 'KRONOR') THEN 'SEK' WHEN marker <> '' THEN marker END AS currency,
        concat_ws(',', CASE WHEN amount IS NULL THEN 'unparseable' END, CASE WHEN amount <= 0 THEN 'non_positive_amount' END,
          CASE WHEN amount < 100 THEN 'suspiciously_low' END, CASE WHEN amount > 500000 THEN 'suspiciously_high' END) AS warnings
    FROM a""", "prices_b")
def nrm_money_sv(t):
    m = t.prices_b.select("item_id", P.money_sv(F.col("price_text")).alias("m"))
    return m.select("item_id", "m.amount", "m.currency", F.array_join("m.warnings", ",").alias("warnings"))


@query("nrm_resolve_price", f"""
    SELECT item_id, coalesce({sql_price('price_original')}, {sql_price('price_text')}) AS value,
      CASE WHEN {sql_price('price_original')} IS NOT NULL THEN 'price_original'
           WHEN {sql_price('price_text')} IS NOT NULL THEN 'price_raw' END AS source FROM prices_b""", "prices_b")
def nrm_resolve_price(t):
    r = t.prices_b.select("item_id", P.resolve_price(
        {"price_original": F.col("price_original"), "price_raw": F.col("price_text")}).alias("r"))
    return r.select("item_id", "r.value", "r.source")


@query("nrm_currency", r"""
    WITH f AS (SELECT item_id, currency, regexp_matches(price_text, '(?i)\b(eur|usd|gbp|dkk|nok|chf)\b') AS fx,
        regexp_matches(price_text, '(?i)\b(sek|kr|krona|kronor)\b') AS home FROM prices_b),
    r AS (SELECT item_id, CASE WHEN fx THEN 'mismatch' WHEN upper(trim(currency)) IN ('SEK', 'KR') OR home THEN 'ok'
        WHEN trim(currency) <> '' THEN 'mismatch' ELSE 'unknown' END AS reason FROM f)
    SELECT item_id, CASE WHEN reason = 'ok' THEN 'SEK' END AS currency, reason FROM r""", "prices_b")
def nrm_currency(t):
    r = t.prices_b.select("item_id", P.resolve_currency(F.col("price_text"), F.col("currency")).alias("r"))
    return r.select("item_id", "r.currency", "r.reason")


@query("nrm_price_bucket", """SELECT item_id, CASE WHEN price_amount <= 920 THEN 'budget' WHEN price_amount <= 940 THEN 'affordable'
    WHEN price_amount <= 960 THEN 'mid' WHEN price_amount <= 980 THEN 'premium' ELSE 'luxury' END AS bucket FROM items_b""", "items_b")
def nrm_price_bucket(t):
    return t.items_b.select("item_id", P.price_bucket(F.col("price_amount"), BOUNDS).alias("bucket"))


_SIZE_TITLE = f"""CASE WHEN regexp_matches(lower(title), '\\d+\\s*-?\\s*sits') THEN
      CASE WHEN CAST(regexp_extract(lower(title), '(\\d+)\\s*-?\\s*sits', 1) AS INT) <= 2 THEN 'small'
           WHEN CAST(regexp_extract(lower(title), '(\\d+)\\s*-?\\s*sits', 1) AS INT) = 3 THEN 'medium' ELSE 'large' END
    WHEN {sql_any('lower(title)', L.FLAGS['size_large'])} THEN 'large'
    WHEN {sql_any('lower(title)', L.FLAGS['size_small'])} THEN 'small' END"""
_SIZE = f"""CASE WHEN width_cm IS NOT NULL THEN CASE WHEN width_cm < 180 THEN 'small' WHEN width_cm > 220 THEN 'large' ELSE 'medium' END
    ELSE coalesce(CASE WHEN raw_size IN ('small', 'medium', 'large') THEN raw_size WHEN contains(lower(raw_size), 'wide') THEN 'large' END,
      {_SIZE_TITLE}, 'medium') END"""


@query("nrm_size_class", f"SELECT item_id, {_SIZE} AS size_class FROM catalog_b", "catalog_b")
def nrm_size_class(t):
    return t.catalog_b.select("item_id", N.size_class(F.col("width_cm"), F.col("raw_size"), F.col("title")).alias("size_class"))


@query("nrm_size_class_title", f"SELECT item_id, coalesce({_SIZE_TITLE}, 'none') AS size_class FROM catalog_b", "catalog_b")
def nrm_size_class_title(t):
    return t.catalog_b.select("item_id", F.coalesce(N.size_class_title(F.col("title")), F.lit("none")).alias("size_class"))


@query("nrm_material_color", f"""SELECT item_id, {sql_canon('raw_material', L.MATERIALS, 'mixed')} AS material,
    {sql_canon('raw_color', L.COLORS, 'multi')} AS color_family FROM catalog_b""", "catalog_b")
def nrm_material_color(t):
    return t.catalog_b.select("item_id", T.canon(F.col("raw_material"), L.MATERIALS, "mixed").alias("material"),
                              T.canon(F.col("raw_color"), L.COLORS, "multi").alias("color_family"))


def _infer_sql(lexicon):
    return (f"coalesce({sql_first(sql_padded('title'), lexicon, True)}, "
            f"{sql_first(sql_padded('description'), lexicon, True)}, 'none')")


@query("nrm_infer_color", f"""SELECT item_id, {_infer_sql(L.COLORS)} AS color_family,
    {_infer_sql(L.MATERIALS)} AS material FROM catalog_b""", "catalog_b")
def nrm_infer_color(t):
    pick = lambda lex: F.coalesce(T.infer_canon(F.col("title"), F.col("description"), lex), F.lit("none"))
    return t.catalog_b.select("item_id", pick(L.COLORS).alias("color_family"), pick(L.MATERIALS).alias("material"))


@query("nrm_product_type", f"""SELECT item_id, coalesce({sql_first("lower(breadcrumb_text || ' ' || title)", L.PRODUCT_TYPES)}, 'none')
    AS product_type FROM catalog_b""", "catalog_b")
def nrm_product_type(t):
    text = F.lower(F.concat_ws(" ", "breadcrumb_text", "title"))
    return t.catalog_b.select("item_id", F.coalesce(T.first_match(text, L.PRODUCT_TYPES), F.lit("none")).alias("product_type"))


_FRAG = "substr(html, strpos(html, '<article>'))"


def _sql_decode(c: str) -> str:
    for _ in range(3):
        for e, ch in T.COMMON_ENTITIES.items():
            c = f"replace({c}, '{e}', chr({ord(ch)}))"
    return c


def sql_unescape(c: str) -> str:
    """Three passes over the references that the given pages hold, closed or not."""
    for _ in range(3):
        for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
            c = f"replace(replace({c}, '&{name};', chr({ord(char)})), '&{name}', chr({ord(char)}))"
    return c


def _title_sql(tag: str) -> str:
    cut = f"regexp_replace({sql_unescape(f'trim(regexp_extract(html, {chr(39)}(?s)<{tag}>(.*?)</{tag}>{chr(39)}, 1))')}, '(?s)<[^>]+>', ' ', 'g')"
    return rf"nullif(trim(regexp_replace({cut}, '[\s' || chr(160) || ']+', ' ', 'g')), '')"


@query("nrm_clean_title", f"SELECT page_id, {_title_sql('title')} AS title, {_title_sql('footer')} AS footer FROM pages_b", "pages_b")
def nrm_clean_title(t):
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    footer = F.regexp_extract("html", r"(?s)<footer>(.*?)</footer>", 1)
    return t.pages_b.select("page_id", T.clean_title(title).alias("title"), T.clean_title(footer).alias("footer"))


@query("nrm_clean_description", rf"""
    WITH raw AS (SELECT page_id, {_sql_decode(f"trim({_FRAG})")} AS s FROM pages_b),
    cut AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(s, '(?i)<\s*br\s*/?\s*>', chr(10), 'g'),
        '(?s)<[^>]+>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS s FROM raw)
    SELECT page_id, sha256(array_to_string(list_filter(list_transform(regexp_split_to_array(s, '\r\n|\r|\n'),
        lambda x: trim(regexp_replace(x, '[\s' || chr(160) || ']+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))) AS description_sha
    FROM cut""", "pages_b")
def nrm_clean_description(t):
    article = F.expr("substr(html, locate('<article>', html))")
    return t.pages_b.select("page_id", F.sha2(T.clean_description(article), 256).alias("description_sha"))


@query("nrm_finite", r"""SELECT item_id, CASE WHEN isfinite(TRY_CAST(s AS DOUBLE)) THEN TRY_CAST(s AS DOUBLE) END AS number
    FROM (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'n/a' WHEN 3 THEN CAST(item_id * 1.5 AS VARCHAR) END AS s FROM items_b)""", "items_b")
def nrm_finite(t):
    s = F.expr("CASE item_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'n/a' WHEN 3 THEN cast(item_id * 1.5 AS string) END")
    return t.items_b.select("item_id", finite(s).alias("number"))


@query("nrm_dim_cm", r"""WITH x AS (SELECT item_id, replace(lower(dim_text), ',', '.') AS s FROM dims_b),
    p AS (SELECT item_id, TRY_CAST(regexp_extract(s, '(-?\d+(?:\.\d+)?)\s*(mm|cm|m)?', 1) AS DOUBLE) AS n,
      regexp_extract(s, '(-?\d+(?:\.\d+)?)\s*(mm|cm|m)?', 2) AS u FROM x)
    SELECT item_id, floor((CASE u WHEN 'mm' THEN n / 10.0 WHEN 'm' THEN n * 100.0 ELSE n END) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS cm FROM p""", "dims_b")
def nrm_dim_cm(t):
    return t.dims_b.select("item_id", (F.floor(P.dim_cm(F.col("dim_text")) * 1e4 + 0.5) / 1e4).alias("cm"))


_TRIP = r"'(-?\d+(?:\.\d+)?)\s*[x×]\s*(-?\d+(?:\.\d+)?)\s*[x×]\s*(-?\d+(?:\.\d+)?)\s*(mm|cm|m)?'"


def _trip(i, a):
    return (f"floor(TRY_CAST(regexp_extract(s, {_TRIP}, {i}) AS DOUBLE) * (CASE regexp_extract(s, {_TRIP}, 4) "
            f"WHEN 'mm' THEN 0.1::DOUBLE WHEN 'm' THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS {a}")


@query("nrm_dim_triplet", f"""WITH x AS (SELECT item_id, replace(lower(triplet_text), ',', '.') AS s FROM dims_b)
    SELECT item_id, {_trip(1, 'w')}, {_trip(2, 'h')}, {_trip(3, 'd')} FROM x""", "dims_b")
def nrm_dim_triplet(t):
    m = t.dims_b.select("item_id", P.dim_triplet_cm(F.col("triplet_text")).alias("m"))
    return m.select("item_id", *[(F.floor(F.col(f"m.{x}") * 100.0 + 0.5) / 100.0).alias(x) for x in "whd"])


def _tags_sql(blob: str, lexicon) -> str:
    return "[" + ", ".join(f"CASE WHEN {sql_any(blob, ts)} THEN '{k}' END" for k, ts in lexicon.items()) + "]"


def _merged_sql(existing: str, blob: str, lexicon, cap: int) -> str:
    full = (f"list_filter(list_transform(list_concat({existing}, {_tags_sql(blob, lexicon)}), lambda x: {sql_token('x')}), "
            f"lambda x: x IS NOT NULL)")
    return (f"array_to_string(list_filter({full}, lambda x, i: list_position({full}, x) = i)[1:{cap}], ',')")


_STYLE_SQL = _merged_sql("style_tags", sql_blob("title", "description", "breadcrumb_text"), L.STYLES, 8)
_ECO_SQL = _merged_sql("CAST([] AS VARCHAR[])", sql_blob("title", "description"), L.ECO, 6)


@query("nrm_style_tags", f"SELECT item_id, {_STYLE_SQL} AS style_tags, {_ECO_SQL} AS eco_tags FROM catalog_b", "catalog_b")
def nrm_style_tags(t):
    items = spread_rows(t.catalog_b.select("item_id", "title", "description", "breadcrumb_text", "style_tags"))
    return N.derive_tags(items).select("item_id", F.array_join("style_tags", ",").alias("style_tags"),
                                             F.array_join("eco_tags", ",").alias("eco_tags"))


_TD = sql_blob("title", "description")
_FLAGS_SQL = f"""{sql_any(_TD, L.FLAGS['modular'])} AS modular,
  (coalesce(lower(trim(size_class)) = 'small', false) OR coalesce(seat_count <= 2, false) OR coalesce(width_cm <= 180, false)
   OR {sql_any(_TD, L.FLAGS['small_space'])}) AS small_space,
  CASE WHEN coalesce(size_class = 'large', false) OR coalesce(seat_count >= 4, false) OR coalesce(weight_kg >= 60, false)
         OR coalesce(shipping_cost >= 1500, false) OR {sql_any(_TD, L.FLAGS['delivery_high'])} THEN 'high'
       WHEN (coalesce(size_class = 'small', false) AND coalesce(seat_count <= 2, true) AND coalesce(weight_kg <= 25, true))
         OR coalesce(shipping_cost BETWEEN 0 AND 300, false) OR {sql_any(_TD, L.FLAGS['delivery_low'])} THEN 'low'
       ELSE 'medium' END AS delivery_complexity"""
_SIZED = f"sized AS (SELECT *, {_SIZE} AS size_class FROM catalog_b)"


def _sized(t):
    return _with_size(t.catalog_b)


def _with_size(items):
    return items.withColumn("size_class", N.size_class(F.col("width_cm"), F.col("raw_size"), F.col("title")))


@query("nrm_item_flags", f"WITH {_SIZED} SELECT item_id, {_FLAGS_SQL} FROM sized", "catalog_b")
def nrm_item_flags(t):
    return N.item_flags(_sized(t)).select("item_id", "modular", "small_space", "delivery_complexity")


_ID_SQL = "substr(sha256(CAST(source_id AS VARCHAR) || '|' || lower(trim(source_url))), 1, 24)"


@query("nrm_stable_id", f"SELECT item_id, {_ID_SQL} AS id FROM catalog_b", "catalog_b")
def nrm_stable_id(t):
    return t.catalog_b.select("item_id", H.stable_id(
        F.col("source_id"), F.lit(None).cast("string"), F.col("source_url"), F.col("title")).alias("id"))


@query("nrm_finalize_items", f"""WITH {_SIZED} SELECT item_id, {_ID_SQL} AS id, {_STYLE_SQL} AS style_tags,
    {_ECO_SQL} AS eco_tags, {_FLAGS_SQL} FROM sized""", "catalog_b")
def nrm_finalize_items(t):
    items = spread_rows(t.catalog_b.drop("raw_material", "raw_color", "brand", "price_amount"))
    return N.finalize_items(_with_size(items)).select(
        "item_id", "id", F.array_join("style_tags", ",").alias("style_tags"),
        F.array_join("eco_tags", ",").alias("eco_tags"), "modular", "small_space", "delivery_complexity")


@query("nrm_discount_pct", """SELECT item_id, CASE WHEN list_price > price_amount AND price_amount > 0 THEN
    floor((1.0::DOUBLE - price_amount / list_price) * 100.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE END AS discount FROM prices_b""", "prices_b")
def nrm_discount_pct(t):
    return t.prices_b.select("item_id", P.discount_pct(F.col("list_price"), F.col("price_amount")).alias("discount"))


# User agents derived from the log: browser family and version follow the event.
_UA = {
    "spark": "CASE event_id % 5 WHEN 0 THEN concat('Mozilla/5.0 Chrome/', event_id % 120, '.0 Safari/537.36') "
             "WHEN 1 THEN concat('Mozilla/5.0 Version/', event_id % 17, '.1 Safari/605') "
             "WHEN 2 THEN concat('Mozilla/5.0 Firefox/', event_id % 90, '.0') WHEN 3 THEN '' ELSE 'curl/8' END",
    "label": "CASE event_id % 5 WHEN 0 THEN concat('Chrome/', event_id % 120) WHEN 1 THEN concat('Safari/', event_id % 17) "
             "WHEN 2 THEN concat('Firefox/', event_id % 90) WHEN 4 THEN 'other' ELSE 'none' END",
}


@query("nrm_user_agent", f"SELECT {_UA['label']} AS label, count(*) AS sessions FROM events GROUP BY 1")
def nrm_user_agent(t):
    ua = t.events.select(F.expr(_UA["spark"]).alias("ua"))
    return ua.groupBy(F.coalesce(T.user_agent_label(F.col("ua")), F.lit("none")).alias("label")).agg(
        F.count("*").alias("sessions"))


_FEED_SQL = """mapped AS (SELECT item_id, source_id, coalesce(nullif(title, ''), nullif(name, ''), '') AS title,
    coalesce(nullif(price, ''), nullif(price_amount, ''), '0') AS price, trim(coalesce(nullif(currency, ''), 'SEK')) AS currency,
    coalesce(nullif(url, ''), nullif(link, ''), '') AS url, coalesce(image_url, '') AS image_url, coalesce(brand, '') AS brand,
    coalesce(description, '') AS description, coalesce(width, '') AS width, coalesce(material, '') AS material,
    coalesce(nullif(color, ''), nullif(colour, ''), '') AS color, coalesce(condition, '') AS new_used
  FROM feed_b WHERE coalesce(nullif(title, ''), nullif(name, '')) IS NOT NULL OR coalesce(nullif(url, ''), nullif(link, '')) IS NOT NULL)"""


@query("nrm_feed_columns", f"WITH {_FEED_SQL} SELECT * EXCLUDE (width) FROM mapped", "feed_b")
def nrm_feed_columns(t):
    mapped = N.map_feed_columns(t.feed_b, keep=("item_id", "source_id"))
    return mapped.select("item_id", "source_id", "title", "price", "currency", "url", "image_url", "brand",
                         "description", "material", "color", "new_used")


_CANON_FEED = """('https://' || lower(regexp_extract(url, '^https://([^/?#]+)', 1)) || regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1) ||
    CASE WHEN contains(url, '?') THEN '?' || array_to_string(list_filter(string_split(split_part(url, '?', 2), '&'),
      lambda x: NOT starts_with(x, 'utm_')), '&') ELSE '' END)"""


@query("nrm_feed_item", f"""WITH {_FEED_SQL},
    n AS (SELECT *, {sql_price('price')} AS price_amount, {_CANON_FEED} AS canonical_url, TRY_CAST(nullif(width, '') AS DOUBLE) AS width_cm,
          CAST(NULL AS VARCHAR) AS raw_size, coalesce(nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), 'Untitled') AS title2
          FROM mapped WHERE trim(url) <> ''),
    m AS (SELECT * EXCLUDE (title), title2 AS title FROM n WHERE price_amount IS NOT NULL)
    SELECT substr(sha256(canonical_url), 1, 24) AS id, source_id, canonical_url, title, nullif(trim(brand), '') AS brand, price_amount,
      currency AS price_currency, {_SIZE} AS size_class, coalesce({sql_canon('material', L.MATERIALS, 'mixed')}, 'mixed') AS material,
      coalesce({sql_canon('color', L.COLORS, 'multi')}, 'multi') AS color_family,
      CASE WHEN contains(lower(new_used), 'second') THEN 'used' ELSE 'new' END AS new_used,
      CAST(CASE WHEN trim(image_url) <> '' THEN 1 ELSE 0 END AS BIGINT) AS image_count FROM m""", "feed_b")
def nrm_feed_item(t):
    mapped = N.map_feed_columns(t.feed_b, keep=("item_id", "source_id"))
    items = N.normalize_feed(spread_rows(mapped), F.col("source_id"))
    return items.select("id", "source_id", "canonical_url", "title", "brand", "price_amount", "price_currency", "size_class",
                        "material", "color_family", "new_used", F.size("images").cast("bigint").alias("image_count"))


_HYG_VIEW = """hyg AS (SELECT c.item_id AS id, CASE WHEN c.item_id % 3 = 0 THEN '  <b>' || c.title || '</b>' ELSE c.title END AS title,
    CASE WHEN c.item_id % 4 = 0 THEN c.description || '<br>Mer' WHEN c.item_id % 4 = 1 THEN NULL ELSE nullif(c.description, '') END AS description,
    CASE WHEN c.item_id % 5 = 0 THEN NULL WHEN c.item_id % 5 = 1 THEN '0' ELSE p.price_text END AS price_amount,
    p.price_original, CASE WHEN c.item_id % 7 = 0 THEN '' ELSE p.currency END AS price_currency
  FROM {c} c JOIN {p} p ON p.item_id = c.item_id)"""


@query("nrm_hygiene_backfill", "WITH " + _HYG_VIEW.format(c="catalog_b", p="prices_b") + f""",
    x AS (SELECT *, trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS nt,
        {sql_price('price_amount')} AS cur, {sql_price('price_original')} AS orig FROM hyg),
    r AS (SELECT unnest([CASE WHEN trim(title) IS DISTINCT FROM nt THEN 'title' END,
       CASE WHEN contains(description, '<br>') THEN 'description' END,
       CASE WHEN cur IS NULL AND orig IS NOT NULL THEN 'price_repaired' WHEN cur IS NOT NULL THEN 'price_normalized' END,
       CASE WHEN coalesce(cur, orig) IS NOT NULL AND trim(price_currency) = '' THEN 'currency_defaulted' END,
       CASE WHEN cur IS NULL AND orig IS NULL THEN 'unresolved_invalid_price' END]) AS reason FROM x)
    SELECT reason, count(*) AS items FROM r WHERE reason IS NOT NULL GROUP BY reason""", "catalog_b prices_b")
def nrm_hygiene_backfill(t):
    sql = _HYG_VIEW.format(c="{catalog_b}", p="{prices_b}")
    items = t.spark.sql(f"WITH {sql} SELECT * FROM hyg", catalog_b=t.catalog_b, prices_b=t.prices_b)
    return N.hygiene_stats(N.hygiene_changes(spread_rows(items)))
