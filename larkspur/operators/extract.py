"""Page extraction over a pages table (page_id, url, html).

JSON blocks are parsed to VARIANT and walked level by level inside the page
row, so the whole cascade is one scan without a shuffle; only pages that no
JSON describes are sent to the HTML parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.folds import let
from larkspur.functions.numbers import js_round
from larkspur.functions import lexicons as L
from larkspur.functions import price as P
from larkspur.functions import text as T
from larkspur.functions import url as U
from larkspur.functions.dom import dom_fields
from larkspur.functions.staging import pin
from larkspur.operators.quality import completeness

SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
STATE_SCRIPT = r"(?is)<script(?![^>]*ld\+json)[^>]*>(.*?)</script>"
LD_JSON = r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"
NEXT_DATA = r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>\s*(\{.*?\})\s*</script>'
WINDOW_STATE = r"(?s)window\.(?:__INITIAL_STATE__|__NUXT__|__PRELOADED_STATE__)\s*=\s*(\{.+?\});\s*(?:</script>|$)"
WINDOW_PARSE = r"(?s)window\.INITIAL_DATA\s*=\s*JSON\.parse\(\s*'(.+?)'\s*\)"


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def _meta(html: Column, name: str) -> Column:
    a = F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:property|name)\s*=\s*["']{name}["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta[^>]*content\s*=\s*["']([^"']*)["'][^>]*(?:property|name)\s*=\s*["']{name}["']""", 1)
    return F.coalesce(T.non_blank(a), T.non_blank(b))


def page_signals(pages: DataFrame) -> DataFrame:
    """Canonical link, og fields, h1, title and the number of JSON-LD blocks and scripts."""
    html, url = F.col("html"), F.col("url")
    canonical = F.regexp_extract(html, r"""(?is)<link[^>]*rel\s*=\s*["'][^"']*canonical[^"']*["'][^>]*href\s*=\s*["']([^"']*)["']""", 1)
    images = _all(html, r"""(?is)<meta[^>]*property\s*=\s*["']og:image["'][^>]*content\s*=\s*["']([^"']+)["']""")
    return pages.select(
        "page_id", "url", U.absolute_url(T.non_blank(canonical), url).alias("canonical_url"),
        U.absolute_url(_meta(html, "og:url"), url).alias("og_url"), _meta(html, "og:type").alias("og_type"),
        F.transform(images, lambda i: U.absolute_url(i, url)).alias("og_images"),
        T.squash(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        T.squash(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")).alias("h1"),
        F.size(_all(html, LD_JSON)).cast("bigint").alias("jsonld_blocks"), F.size(_all(html, SCRIPT)).cast("bigint").alias("scripts"))


# ---- JSON trees -----------------------------------------------------------------------------------------


def get(v: Column, *paths: str, as_: str = "string") -> Column:
    """First path that yields a non-blank value of the type."""
    found = [F.try_variant_get(v, f"$.{p}" if not p.startswith("$") else p, as_) for p in paths]
    if as_ == "string":
        found = [F.nullif(F.trim(f), F.lit("")) for f in found]
    return F.coalesce(*found)


def as_list(v: Column, path: str = "$") -> Column:
    """Array elements at the path; one object counts as a single element; else empty."""
    arr = F.try_variant_get(v, path, "array<variant>")
    one = F.try_variant_get(v, path, "variant")
    is_object = F.try_variant_get(v, path, "map<string,variant>").isNotNull()
    empty = F.array().cast("array<variant>")
    return F.coalesce(arr, F.when(is_object, F.array(one)), empty)


def _children(v: Column) -> Column:
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"),
                      F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), empty)


def walk(df: DataFrame, roots: str, out: str) -> DataFrame:
    """Add every node under the roots, level by level, as one array.

    The levels of a page are walked inside its row until one is empty. No state nests deeper than its text has
    opening brackets, so their number bounds the steps; steps after the last level do nothing.
    """
    def step(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["level"], _children))
        return F.when(F.size(state["level"]) == 0, state).otherwise(
            F.struct(F.concat(state["nodes"], state["level"]).alias("nodes"), below.alias("level")))

    empty = F.array().cast("array<variant>")
    brackets = F.transform(roots, lambda v: F.length(F.regexp_replace(F.to_json(v), r"[^\[{]+", "")))
    start = F.struct(empty.alias("nodes"), F.coalesce(roots, empty).alias("level"))
    steps = F.sequence(F.lit(0), F.coalesce(F.array_max(brackets), F.lit(0)) + 1)
    return pin(df, **{out: F.aggregate(steps, start, step, lambda state: state["nodes"])})


def keys_of(v: Column) -> Column:
    return F.transform(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.lower)


def has_key(v: Column, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(keys_of(v), F.array(*[F.lit(n) for n in names])), F.lit(False))


def parse_all(texts: Column) -> Column:
    return F.array_compact(F.transform(texts, lambda t: F.try_parse_json(t)))


def with_blocks(pages: DataFrame, min_script_chars: int = 0, max_embedded: int | None = None) -> DataFrame:
    """Add `ld` (parsed JSON-LD blocks) and `embedded` (parsed state objects, all of them by default)."""
    html = F.col("html")
    unescaped = F.transform(_all(html, WINDOW_PARSE), lambda t: F.replace(F.replace(F.replace(
        t, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    large = F.filter(F.transform(_all(html, STATE_SCRIPT), F.trim), lambda t: (F.length(t) >= min_script_chars) & F.rlike(t, F.lit(r"^[\{\[]"))
                     & F.rlike(F.lower(t), F.lit("price|product|images|sku|variant|name")))
    state = F.concat(_all(html, NEXT_DATA), unescaped, _all(html, WINDOW_STATE), large)
    parsed = parse_all(F.array_distinct(state))
    return pin(pages, ld=parse_all(_all(html, LD_JSON)), embedded=parsed if max_embedded is None else F.slice(parsed, 1, max_embedded))


def embedded_json(pages: DataFrame) -> DataFrame:
    return with_blocks(pages).select("page_id", F.size("ld").cast("bigint").alias("ld_blocks"), F.size("embedded").cast("bigint").alias("embedded_blocks"),
                                     F.transform("embedded", lambda v: F.array_join(F.array_sort(F.coalesce(keys_of(v), F.array().cast("array<string>"))), ",")).alias("top_keys"))


def _objects(df: DataFrame) -> DataFrame:
    """Add `objs`: JSON-LD objects of blocks and arrays, then of @graph lists, level by level to the last.

    A page has no more levels than it names @graph; where a level is empty the steps left do nothing.
    """
    cur = pin(df, _o=F.flatten(F.transform("ld", lambda b: as_list(b))))
    deeper = lambda edge: F.flatten(F.transform(edge, lambda o: as_list(o, "$['@graph']")))
    step = lambda s, _: F.when(F.size(s["edge"]) == 0, s).otherwise(let(deeper(s["edge"]), lambda more: F.struct(
        F.concat(s["all"], more).alias("all"), more.alias("edge"))))
    levels = F.regexp_count("html", F.lit('"@graph"'))
    walked = F.aggregate(F.sequence(F.lit(1), levels), F.struct(F.col("_o").alias("all"), F.col("_o").alias("edge")), step, lambda s: s["all"])
    return pin(cur, objs=F.when(levels > 0, walked).otherwise(F.col("_o"))).drop("_o")


def _is_type(o: Column, name: str) -> Column:
    one = F.lower(F.try_variant_get(o, "$['@type']", "string"))
    many = F.transform(F.try_variant_get(o, "$['@type']", "array<string>"), F.lower)
    return F.coalesce(one == name, F.lit(False)) | F.coalesce(F.array_contains(many, name), F.lit(False))


def image_list(v: Column, path: str) -> Column:
    """Image urls under a key: a string, a list of strings, or objects with contentUrl or url."""
    one = F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))
    listed = F.array_compact(F.transform(as_list(v, path), lambda x: F.coalesce(
        F.try_variant_get(x, "$.contentUrl", "string"), F.try_variant_get(x, "$.url", "string"), F.try_variant_get(x, "$", "string"))))
    is_text = one.isNotNull() & ~F.rlike(F.coalesce(one, F.lit("")), F.lit(r"^[\{\[]"))
    return F.when(is_text, F.array(one)).otherwise(listed)


def jsonld_product(pages: DataFrame) -> DataFrame:
    """Add `product`: the first JSON-LD product with offers and name, else the last product."""
    objs = _objects(pages if "ld" in pages.columns else with_blocks(pages))
    found = pin(objs, _p=F.filter("objs", lambda o: _is_type(o, "product")))
    full = F.filter("_p", lambda o: F.try_variant_get(o, "$.offers", "variant").isNotNull() & get(o, "name").isNotNull())
    return pin(found, product=F.coalesce(F.try_element_at(full, F.lit(1)), F.try_element_at("_p", F.lit(-1)))).drop("_p")


def _prop(v: Column, *names: str) -> Column:
    """additionalProperty value by name."""
    hits = F.filter(as_list(v, "$.additionalProperty"), lambda x: F.lower(F.coalesce(get(x, "name", "propertyID"), F.lit(""))).isin(*names))
    return get(F.try_element_at(hits, F.lit(1)), "value")


def _quantity(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.coalesce(
        P.quantity_cm(F.try_variant_get(v, f"$.{p}.value", "string"), F.coalesce(
            F.try_variant_get(v, f"$.{p}.unitCode", "string"), F.try_variant_get(v, f"$.{p}.unitText", "string"), F.lit(""))),
        F.try_variant_get(v, f"$.{p}", "double")) for p in paths])


def jsonld_fields(v: Column) -> Column:
    """Product struct of a JSON-LD product."""
    offer = F.try_element_at(as_list(v, "$.offers"), F.lit(1))
    spec = F.try_element_at(as_list(offer, "$.priceSpecification"), F.lit(1))
    return F.struct(
        get(v, "name").alias("title"), get(v, "url", "id").alias("url"), image_list(v, "$.image").alias("images"),
        F.coalesce(get(v, "brand.name"), get(v, "brand")).alias("brand"),
        F.coalesce(F.array_join(F.try_variant_get(v, "$.description", "array<string>"), " "), get(v, "description")).alias("description"),
        F.coalesce(get(offer, "price"), get(spec, "price")).alias("price_raw"),
        F.coalesce(get(offer, "priceCurrency"), get(spec, "priceCurrency")).alias("currency"),
        F.coalesce(get(v, "material.name", "material.value"), get(v, "material"), _prop(v, "material", "materiel", "tyg")).alias("material"),
        F.coalesce(get(v, "color"), _prop(v, "färg", "color", "colour")).alias("color"),
        F.coalesce(_quantity(v, "width"), P.dim_cm(_prop(v, "bredd", "width", "bredd (cm)"))).alias("width_cm"),
        F.coalesce(_quantity(v, "height"), P.dim_cm(_prop(v, "höjd", "height", "höjd (cm)"))).alias("height_cm"),
        F.coalesce(_quantity(v, "depth"), P.dim_cm(_prop(v, "djup", "depth", "djup (cm)"))).alias("depth_cm"),
        identity(v).alias("identity"), T.availability(get(offer, "availability")).alias("availability"),
        get(v, "originalPrice", "listPrice").try_cast("double").alias("price_original"))


def identity(v: Column) -> Column:
    """struct(sku, mpn, gtin)."""
    return F.struct(get(v, "sku", "articleNumber", "productID").alias("sku"), get(v, "mpn").alias("mpn"),
                    get(v, "gtin13", "gtin", "gtin14", "gtin12", "gtin8", "ean").alias("gtin"))


def embedded_fields(v: Column) -> Column:
    """Product struct of a product-like state node."""
    in_stock = F.coalesce(F.try_variant_get(v, "$.inStock", "boolean"), F.try_variant_get(v, "$.available", "boolean"))
    return F.struct(
        get(v, "name", "title", "productName").alias("title"), get(v, "canonicalUrl", "url").alias("url"),
        F.coalesce(*[F.when(F.size(image_list(v, f"$.{k}")) > 0, image_list(v, f"$.{k}")) for k in ("images", "image", "gallery", "media")],
                   F.array().cast("array<string>")).alias("images"),
        F.coalesce(get(v, "brand.name"), get(v, "brand")).alias("brand"), get(v, "description").alias("description"),
        get(v, "price", "priceAmount", "currentPrice", "salePrice", "offers.price").alias("price_raw"),
        get(v, "currency", "priceCurrency", "offers.priceCurrency").alias("currency"),
        get(v, "material", "materialName", "fabric", "coverMaterial").alias("material"),
        get(v, "color", "colorName", "colorFamily", "colour", "variantColor").alias("color"),
        F.coalesce(_quantity(v, "dimensionsCm.w", "dimensions.width", "width")).alias("width_cm"),
        F.coalesce(_quantity(v, "dimensionsCm.h", "dimensions.height", "height")).alias("height_cm"),
        F.coalesce(_quantity(v, "dimensionsCm.d", "dimensions.depth", "depth")).alias("depth_cm"),
        identity(v).alias("identity"),
        F.when(in_stock, "in_stock").when(~in_stock, "out_of_stock").otherwise(T.availability(get(v, "availability"))).alias("availability"),
        get(v, "originalPrice", "compareAtPrice", "listPrice", "priceOriginal", "regularPrice", "wasPrice").try_cast("double").alias("price_original"))


def embedded_product(pages: DataFrame) -> DataFrame:
    """Add `node`: the best product-like node of the embedded state (title 2, images 1.5, price 1.5, identity 0.5)."""
    blocks = pages if "embedded" in pages.columns else with_blocks(pages)
    nodes = walk(blocks, "embedded", "_nodes")
    like = pin(nodes, _c=F.filter("_nodes", lambda n: has_key(n, "name", "title", "productname")
                                  & has_key(n, "price", "priceamount", "offers", "currentprice", "saleprice")
                                  & (F.length(F.coalesce(get(n, "name", "title", "productName"), F.lit(""))) >= 3)))
    has_images = lambda n: F.size(F.concat(*[image_list(n, f"$.{k}") for k in ("images", "image", "gallery", "media")])) > 0
    score = lambda n: (F.lit(2.0) + F.when(has_images(n), 1.5).otherwise(0.0)
                       + F.when(P.price_amount(get(n, "price", "priceAmount", "currentPrice", "salePrice", "offers.price")).isNotNull(), 1.5).otherwise(0.0)
                       + F.when(get(n, "sku", "gtin").isNotNull(), 0.5).otherwise(0.0))
    scored = pin(like, _s=F.transform("_c", score))
    best = F.try_element_at("_c", F.array_position("_s", F.array_max("_s")).cast("int"))
    return pin(scored, node=F.when(F.size("_c") > 0, best), node_score=F.array_max("_s")).drop("_nodes", "_c", "_s")


# Key sets that make an array element look like a product, with their points.
ARRAY_KEYS = [(3, ("name", "title", "displayname", "productname", "product_name")),
              (3, ("price", "currentprice", "saleprice", "price_amount", "priceamount")),
              (2, ("url", "slug", "href", "link", "product_url", "producturl")),
              (1, ("image", "images", "img", "imageurl", "image_url", "thumbnail")),
              (1, ("sku", "productid", "product_id", "id", "articleno", "articlenumber"))]


def state_products(pages: DataFrame) -> DataFrame:
    """One row per product of the best product array in the page state (listing pages).

    Arrays need three or more elements, at least 70 % objects; the score counts
    all elements, and all elements of the winner are emitted.
    """
    blocks = pages if "embedded" in pages.columns else with_blocks(pages)
    nodes = walk(blocks, "embedded", "_nodes")
    arrays = pin(nodes, _a=F.filter(F.array_compact(F.transform("_nodes", lambda n: F.try_variant_get(n, "$", "array<variant>"))),
                                    lambda a: (F.size(a) >= 3) & (F.size(F.filter(a, lambda x: keys_of(x).isNotNull())) >= F.size(a) * 0.7)))
    points = lambda x: sum((F.when(has_key(x, *names), p).otherwise(0) for p, names in ARRAY_KEYS), F.lit(0))
    scored = pin(arrays, _s=F.transform("_a", lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + points(x))))
    best = F.try_element_at("_a", F.array_position("_s", F.array_max("_s")).cast("int"))
    rows = scored.where(F.array_max("_s") > 0).select("page_id", "url", F.posexplode(best).alias("position", "v"))
    return pin(rows, p=embedded_fields(F.col("v"))).where(F.col("p.title").isNotNull()).select("page_id", "url", "position", "p.*")


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """Breadcrumb names of the first BreadcrumbList, ordered by position."""
    objs = _objects(pages if "ld" in pages.columns else with_blocks(pages))
    first = F.try_element_at(F.filter("objs", lambda o: _is_type(o, "breadcrumblist")), F.lit(1))
    entries = F.transform(as_list(first, "$.itemListElement"), lambda e: F.struct(
        F.coalesce(F.try_variant_get(e, "$.position", "int"), F.lit(0)).alias("position"), get(e, "name", "item.name").alias("name")))
    return objs.select("page_id", F.array_compact(F.transform(F.array_sort(entries), lambda e: e["name"])).alias("breadcrumbs"))


def variants(products: DataFrame, v: str = "product") -> DataFrame:
    """One row per product variant: sku, colour, material, price, available."""
    node = F.col(v)
    lists = [as_list(node, f"$.{k}") for k in ("hasVariant", "model", "variants", "skus", "options", "configurations")]
    listed = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    rows = products.select("page_id", F.posexplode(listed).alias("position", "x"))
    offer = F.try_element_at(as_list(F.col("x"), "$.offers"), F.lit(1))
    stated = F.coalesce(F.try_variant_get("x", "$.inStock", "boolean"), F.try_variant_get("x", "$.available", "boolean"))
    by_offer = F.when(offer.isNotNull(), F.lower(F.coalesce(get(offer, "availability"), F.lit(""))) != "outofstock")
    return rows.select(
        "page_id", "position", get(F.col("x"), "name", "label").alias("name"), get(F.col("x"), "sku", "articleNumber").alias("sku"),
        get(F.col("x"), "color", "colorName").alias("color"), get(F.col("x"), "material", "fabric").alias("material"),
        F.coalesce(get(F.col("x"), "price", "currentPrice"), get(offer, "price")).try_cast("double").alias("price"),
        F.coalesce(by_offer, stated, F.lit(True)).alias("available"))


def apply_field_map(df: DataFrame, v: str, field_map: dict[str, list[str]]) -> DataFrame:
    """Recipe strategy: per field, the first non-empty of its JSON paths; [*] takes the first element."""
    cols = [get(F.col(v), *[p.replace("[*]", "[0]") for p in paths]).alias(field) for field, paths in field_map.items()]
    return df.select("page_id", "url", *cols)


# ---- DOM and enrichment ------------------------------------------------------------------------------------


def spec_pairs(pages: DataFrame) -> DataFrame:
    """(page_id, position, key, value) from definition lists, tables and 'key: value' list items."""
    return pages.select("page_id", dom_fields("html").alias("d")).select(
        "page_id", F.posexplode("d.pairs").alias("position", "p")).select("page_id", "position", "p.key", "p.value")


def facets(pairs: DataFrame, key_chars: int | None = None, value_chars: int | None = None) -> DataFrame:
    """Facet map per page; the last value of a repeated key wins. Limits leave out longer keys and values."""
    kept = pairs
    for column, limit in (("key", key_chars), ("value", value_chars)):
        kept = kept if limit is None else kept.where(F.length(column) < limit)
    last = kept.groupBy("page_id", "key").agg(F.max_by("value", "position").alias("value"))
    return last.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("facets"))


# Folded spec labels by field.
SPEC_LABELS = {
    "seat_height_cm": ["sitthojd", "seatheight"],
    "seat_depth_cm": ["sittdjup", "seatdepth"],
    "seat_width_cm": ["sittbredd", "seatwidth"],
    "seat_count": ["antalsitsar", "antalsittplatser", "seats", "numberofseats", "sitsar"],
    "weight_kg": ["vikt", "weight", "totalvikt"],
    "frame_material": ["stomme", "frame", "stommaterial", "framematerial"],
    "cover_material": ["kladsel", "kladselmaterial", "cover", "upholstery", "tygkladsel", "tyg"],
    "leg_material": ["ben", "legs", "fotter", "feet", "benmaterial", "legmaterial"],
    "cushion_filling": ["kuddfyllning", "fyllning", "filling", "cushion", "sittfyllning"],
}


def rich_specs(pairs: DataFrame) -> DataFrame:
    """Typed furniture specs per page; the first usable value of each field wins."""
    label = T.fold_label(F.col("key"))
    number = F.regexp_extract("value", r"([\d.]+)", 1).try_cast("double")
    count = F.regexp_extract("value", r"(\d+)", 1).try_cast("int")
    usable = {"seat_count": F.when(count.between(1, 20), count.cast("double")), "weight_kg": F.when((number > 0) & (number < 500), js_round(number, 1))}
    aggs = []
    for field, labels in SPEC_LABELS.items():
        hit = label.isin(*labels)
        if field.endswith("_cm"):
            value = P.dim_cm(F.col("value"))
        else:
            value = usable.get(field, F.col("value"))
        aggs.append(F.min_by(value, F.when(hit & value.isNotNull(), F.col("position"))).alias(field))
    return pairs.groupBy("page_id").agg(*aggs)


def extract_products(pages: DataFrame, recipe: dict[str, list[str]] | None = None) -> DataFrame:
    """Cascade per page: JSON-LD, else embedded state, else recipe, else DOM; title and canonical url required.

    Every strategy is a struct of the same page row and the first valid one is
    taken, so no strategy tables are united or ranked. The HTML parser sees
    only pages that the JSON strategies leave empty.
    """
    signals = pages.withColumns({
        "_canonical": F.coalesce(*[U.absolute_url(T.non_blank(F.regexp_extract("html", rx, 1)), F.col("url")) for rx in (
            r"""(?is)<link[^>]*rel\s*=\s*["'][^"']*canonical[^"']*["'][^>]*href\s*=\s*["']([^"']*)["']""",
            r"""(?is)<meta[^>]*property\s*=\s*["']og:url["'][^>]*content\s*=\s*["']([^"']*)["']""")], F.col("url"))})
    found = embedded_product(jsonld_product(with_blocks(signals)))
    staged = pin(found, ld_p=jsonld_fields(F.col("product")), em_p=embedded_fields(F.col("node")))
    usable = lambda c: F.col(f"{c}.title").isNotNull()
    recipe_ok = F.lit(False)
    if recipe:
        fields = {f: get(F.try_element_at("embedded", F.lit(1)), *[p.replace("[*]", "[0]") for p in paths]) for f, paths in recipe.items()}
        staged = pin(staged, rc_title=fields.get("title"), rc_price=fields.get("price_raw"))
        recipe_ok = F.col("rc_title").isNotNull()
    needs_dom = ~usable("ld_p") & ~usable("em_p") & ~recipe_ok
    dommed = pin(staged, dom=dom_fields(F.when(needs_dom, F.col("html"))))
    method = F.when(usable("ld_p"), "jsonld").when(usable("em_p"), "embedded_json").when(recipe_ok, "recipe").when(
        F.col("dom.title").isNotNull(), "dom")
    pick = lambda f, dom=None: F.when(F.col("method") == "jsonld", F.col(f"ld_p.{f}")).when(
        F.col("method") == "embedded_json", F.col(f"em_p.{f}")).otherwise(F.col(f"dom.{dom}") if dom else None)
    base = dommed.withColumn("method", method).where(F.col("method").isNotNull())
    title = F.when(F.col("method") == "recipe", F.col("rc_title")).otherwise(pick("title", "title")) if recipe else pick("title", "title")
    raw = F.when(F.col("method") == "recipe", F.col("rc_price")).otherwise(pick("price_raw", "price_raw")) if recipe else pick("price_raw", "price_raw")
    flat = base.select(
        "page_id", F.col("url").alias("product_url"), "method",
        F.coalesce(U.absolute_url(pick("url"), F.col("url")), F.col("_canonical")).alias("canonical_url"),
        T.clean_title(title).alias("title"), U.normalize_images(F.coalesce(pick("images", "images"), F.array().cast("array<string>")), F.col("url")).alias("images"),
        pick("brand", "brand").alias("brand"), pick("description", "description").alias("description"), raw.alias("price_raw"),
        F.upper(pick("currency")).alias("_cur"), pick("material").alias("_mat"), pick("color").alias("_col"),
        *[pick(f"{d}_cm").alias(f"{d}_cm") for d in ("width", "height", "depth")], pick("availability").alias("availability"),
        pick("price_original").alias("price_original"))
    priced = pin(flat, money=P.money_sv(F.col("price_raw")))
    return enrich(priced)


def enrich(p: DataFrame) -> DataFrame:
    """Extracted value, else one inferred from title and description; discount, warnings and completeness."""
    currency = F.coalesce(F.nullif("_cur", F.lit("")), F.col("money.currency"))
    material = F.coalesce("_mat", T.infer_canon(F.col("title"), F.col("description"), L.MATERIALS))
    color = F.coalesce("_col", T.infer_canon(F.col("title"), F.col("description"), L.COLORS))
    size = F.coalesce(F.col("width_cm"), F.col("height_cm"), F.col("depth_cm")).isNotNull()
    out = p.withColumns({"price_amount": F.col("money.amount"), "price_currency": currency, "material": material, "color": color})
    flags = {"title": F.col("title").isNotNull(), "canonical": F.rlike("canonical_url", F.lit("^https?://")), "images": F.size("images") > 0,
             "price_amount": F.col("price_amount").isNotNull(), "price_currency": F.col("price_currency").isNotNull(),
             "description": F.col("description").isNotNull(), "dimensions": size, "material": F.col("material").isNotNull(),
             "color": F.col("color").isNotNull(), "brand": F.col("brand").isNotNull()}
    warnings = F.concat(
        F.array_compact(F.array(F.when(F.size("images") == 0, "images:none_found"),
                                F.when(F.col("_cur") != F.col("money.currency"), "price:currency_mismatch"))),
        F.transform(F.filter("money.warnings", lambda w: w != "missing"), lambda w: F.concat(F.lit("price:"), w)))
    return out.where(F.col("title").isNotNull() & flags["canonical"]).withColumns({
        "completeness": completeness(flags), "warnings": warnings,
        "discount_pct": P.discount_pct(F.col("price_original"), F.col("price_amount"))}).drop("_cur", "_mat", "_col", "money")


# ---- links, rendering, failures ---------------------------------------------------------------------------------


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link, kind) of anchors, item-list entries and pagination; fragments dropped, distinct per page."""
    strip = lambda u: F.regexp_replace(U.absolute_url(u, F.col("url")), "#.*$", "")
    anchors = F.transform(_all(F.col("html"), r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']+)["']"""), strip)
    paged = F.filter(anchors, lambda u: F.rlike(u, F.lit(r"page=|\?p=|/page/")))
    nxt = F.transform(_all(F.col("html"), r"""(?is)<link[^>]*rel\s*=\s*["']next["'][^>]*href\s*=\s*["']([^"']+)["']"""), strip)
    lists = F.filter(F.flatten(F.transform(parse_all(_all(F.col("html"), LD_JSON)), lambda b: as_list(b))), lambda o: _is_type(o, "itemlist"))
    entries = F.flatten(F.transform(lists, lambda o: F.array_compact(F.transform(as_list(o, "$.itemListElement"), lambda e: strip(get(e, "url"))))))
    kind = lambda name, arr: F.transform(F.array_distinct(arr), lambda u: F.struct(u.alias("link"), F.lit(name).alias("kind")))
    return pages.select("page_id", F.inline(F.concat(
        kind("anchor", anchors), kind("pagination", F.concat(nxt, paged)), kind("itemlist", entries))))


BLOCK_RULES = [("cloudflare", "you have been blocked|attention required|checking your browser|cf-challenge|cf-error-details"),
               ("akamai", "access denied"), ("datadome", "captcha")]


def render_flags(pages: DataFrame) -> DataFrame:
    """Block page, or two of four script-shell signals: little text, empty root, noscript notice, no product signal."""
    html, low = F.col("html"), F.lower("html")
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript|template|title)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    blocked = F.rlike(low, F.lit("perimeterx|px-captcha"))
    for vendor, rx in BLOCK_RULES:
        blocked = blocked | (F.contains(low, F.lit(vendor)) & F.rlike(low, F.lit(rx)))
    root = F.rlike(html, F.lit(r"""(?is)<div[^>]*id\s*=\s*["'](__next|app|root)["'][^>]*>\s*</div>"""))
    notice = F.rlike(html, F.lit(r"(?is)<noscript[^>]*>[^<]*javascript"))
    h1 = F.length(T.squash(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " "))) >= 8
    product = h1 | F.rlike(html, F.lit(r"""(?i)og:title|product:price|itemprop\s*=\s*["']price|"@type"\s*:\s*"Product\b"""))
    flags = {"low_text": F.octet_length(T.squash(body)) < 2048, "empty_root": root, "noscript_notice": notice, "no_product_signal": ~product}
    staged = pages.withColumns({"blocked": blocked, **flags})
    score = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return staged.select("page_id", "blocked", *flags, score.cast("bigint").alias("score"), (F.col("blocked") | (score >= 2)).alias("needs_render"))


def extraction_failures(pages: DataFrame, products: DataFrame) -> DataFrame:
    """Pages that produced no product, with the failure type and signal counts."""
    left = pages.join(products.select("page_id"), "page_id", "left_anti")
    signals = page_signals(left)
    kind = F.when(F.coalesce("title", "h1").isNull() | ((F.col("title") == "") & (F.col("h1") == "")), "fetch").when(
        F.col("jsonld_blocks") > 0, "validate").otherwise("parse")
    return signals.select("page_id", kind.alias("failure_type"), "jsonld_blocks", "scripts")
