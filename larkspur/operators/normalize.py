"""Catalog normalisation jobs: feed rows and crawled items to clean item columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import lexicons as L
from larkspur.functions import price as P
from larkspur.functions import text as T
from larkspur.functions import url as U
from larkspur.functions.hashing import short_sha, stable_id
from larkspur.functions.staging import pin


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


# Column aliases of product feeds, first non-empty wins.
FEED_ALIASES = {
    "title": ["title", "name", "Title"],
    "price": ["price", "Price", "price_amount", "priceAmount"],
    "currency": ["currency", "Currency", "priceCurrency"],
    "url": ["url", "link", "source_url", "sourceUrl"],
    "image_url": ["image_url", "image", "image_url_1", "imageUrl"],
    "brand": ["brand", "Brand"],
    "description": ["description", "Description", "descriptionShort"],
    "width": ["width", "width_cm", "Width"],
    "height": ["height", "height_cm", "Height"],
    "depth": ["depth", "depth_cm", "Depth"],
    "material": ["material", "Material"],
    "color": ["color", "colour", "Color", "colorFamily"],
    "new_used": ["new_used", "newUsed", "condition"],
}


def map_feed_columns(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One string column per field from its aliases; rows with neither title nor url are dropped."""
    defaults = {"price": "0", "currency": "SEK"}
    # Exact names: alias lists may differ from a present column only by case.
    present = set(raw.columns)
    cols = []
    for field, aliases in FEED_ALIASES.items():
        found = [F.nullif(F.col(f"`{a}`").cast("string"), F.lit("")) for a in aliases if a in present]
        cols.append(F.coalesce(*found, F.lit(defaults.get(field, ""))).alias(field))
    mapped = raw.select(*keep, *cols)
    return mapped.withColumn("currency", F.trim("currency")).where((F.col("title") != "") | (F.col("url") != ""))


def size_class_title(title: Column) -> Column:
    """Seat count in the title first, then keywords; null where nothing is found."""
    s = F.lower(title)
    seats = F.regexp_extract(s, r"(\d+)\s*-?\s*sits", 1).try_cast("int")
    return (
        F.when(seats <= 2, "small").when(seats == 3, "medium").when(seats >= 4, "large")
        .when(T.contains_any(s, L.FLAGS["size_large"]), "large")
        .when(T.contains_any(s, L.FLAGS["size_small"]), "small")
    )


def size_class(width: Column, raw: Column, title: Column) -> Column:
    """Width, else stated class, else title, else medium."""
    s = T.norm_token(raw)
    stated = (
        F.when(s.isin("small", "medium", "large"), s)
        .when(T.contains_any(s, ["small", "compact"]), "small")
        .when(T.contains_any(s, ["large", "wide"]), "large")
    )
    return F.when(width.isNotNull(), P.size_class_from_width(width)).otherwise(
        F.coalesce(stated, size_class_title(title), F.lit("medium")))


def new_used(c: Column) -> Column:
    return F.when(T.contains_any(F.lower(c), ["used", "second", "begagnad"]), "used").otherwise("new")


def normalize_feed(mapped: DataFrame, source_id: Column) -> DataFrame:
    """Mapped feed rows to items; rows without a valid price or url are dropped."""
    number = lambda name: F.col(name).try_cast("double")
    w, h, d = number("width"), number("height"), number("depth")
    url = F.trim("url")
    title = F.coalesce(T.clean_title(F.col("title")), F.lit("Untitled"))
    image = F.trim("image_url")
    valid = pin(mapped, _price=P.price_amount(F.col("price")), _url=url).where(F.col("_price").isNotNull() & (F.col("_url") != ""))
    staged = pin(valid, _title=title, _canonical=U.canonical_url(F.col("_url")))
    return staged.select(
        short_sha(F.col("_canonical")).alias("id"),
        source_id.alias("source_id"), F.lit("feed").alias("source_type"),
        F.col("_url").alias("source_url"), F.col("_canonical").alias("canonical_url"),
        F.col("_title").alias("title"), T.non_blank(F.col("brand")).alias("brand"),
        T.clean_description(F.col("description")).alias("description"),
        F.col("_price").alias("price_amount"), F.col("currency").alias("price_currency"),
        F.when(F.coalesce(w, h, d).isNotNull(), F.struct(
            F.coalesce(w, F.lit(0.0)).alias("w"), F.coalesce(h, F.lit(0.0)).alias("h"),
            F.coalesce(d, F.lit(0.0)).alias("d"))).alias("dimensions_cm"),
        size_class(w, F.lit(None).cast("string"), F.col("_title")).alias("size_class"),
        F.coalesce(T.canon(F.col("material"), L.MATERIALS, "mixed"), F.lit("mixed")).alias("material"),
        F.coalesce(T.canon(F.col("color"), L.COLORS, "multi"), F.lit("multi")).alias("color_family"),
        new_used(F.col("new_used")).alias("new_used"),
        F.when(image != "", F.array(F.struct(image.alias("url"), F.col("_title").alias("alt"))))
        .otherwise(F.array().cast("array<struct<url:string,alt:string>>")).alias("images"),
        F.array().cast("array<string>").alias("style_tags"), F.array().cast("array<string>").alias("eco_tags"),
        F.lit("medium").alias("delivery_complexity"), F.lit("in_stock").alias("availability"),
        F.lit(False).alias("small_space"), F.lit(False).alias("modular"), F.lit(True).alias("is_active"),
    )


def merged_tags(existing: Column, derived: Column, cap: int) -> Column:
    """Existing then derived tags, normalised, distinct, first `cap` kept."""
    return F.slice(F.array_distinct(T.norm_tokens(F.concat(
        F.coalesce(existing, F.array().cast("array<string>")), derived))), 1, cap)


def _blob(df: DataFrame, *names: str) -> Column:
    return T.text_blob(*[F.col(n) for n in names if n in df.columns])


def derive_tags(items: DataFrame, style_cap: int = 8, eco_cap: int = 6) -> DataFrame:
    """style_tags and eco_tags, at most so many, with keyword tags added."""
    blobs = pin(items, _style=_blob(items, "title", "description", "product_type", "breadcrumb_text", "facet_text"),
                _eco=_blob(items, "title", "description", "material", "cover_material", "frame_material"))
    style, eco = T.tags_of(F.col("_style"), L.STYLES), T.tags_of(F.col("_eco"), L.ECO)
    return blobs.withColumns({
        "style_tags": merged_tags(col_or_null(items, "style_tags", "array<string>"), style, style_cap),
        "eco_tags": merged_tags(col_or_null(items, "eco_tags", "array<string>"), eco, eco_cap),
    }).drop("_style", "_eco")


def derive_modular(items: DataFrame) -> Column:
    return T.contains_any(_blob(items, "title", "description", "product_type", "category_label"), L.FLAGS["modular"])


def derive_small_space(items: DataFrame) -> Column:
    size = T.norm_token(col_or_null(items, "size_class"))
    seats, width = col_or_null(items, "seat_count", "bigint"), col_or_null(items, "width_cm", "double")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (yes(size == "small") | yes(seats <= 2) | yes(width <= 180)
            | T.contains_any(_blob(items, "title", "description"), L.FLAGS["small_space"]))


def delivery_complexity(items: DataFrame) -> Column:
    size = F.coalesce(T.norm_token(col_or_null(items, "size_class")), F.lit(""))
    seats, weight = col_or_null(items, "seat_count", "bigint"), col_or_null(items, "weight_kg", "double")
    shipping = col_or_null(items, "shipping_cost", "double")
    text = _blob(items, "title", "description", "delivery_eta")
    high = ((size == "large") | (seats >= 4) | (weight >= 60) | (shipping >= 1500)
            | T.contains_any(text, L.FLAGS["delivery_high"]))
    low = (((size == "small") & F.coalesce(seats <= 2, F.lit(True)) & F.coalesce(weight <= 25, F.lit(True)))
           | shipping.between(0, 300) | T.contains_any(text, L.FLAGS["delivery_low"]))
    return F.when(high, "high").when(low, "low").otherwise("medium")


def item_flags(items: DataFrame) -> DataFrame:
    true = lambda n: F.coalesce(col_or_null(items, n, "boolean"), F.lit(False))
    stated = T.norm_token(col_or_null(items, "delivery_complexity"))
    return items.withColumns({
        "modular": true("modular") | derive_modular(items),
        "small_space": true("small_space") | derive_small_space(items),
        "delivery_complexity": F.when(stated.isin("low", "high"), stated).otherwise(delivery_complexity(items)),
    })


def finalize_items(items: DataFrame) -> DataFrame:
    """Tags, flags and the stable id in one projection pass."""
    flagged = item_flags(derive_tags(items))
    return flagged.withColumn("id", stable_id(
        F.coalesce(F.col("source_id").cast("string"), F.lit("")), col_or_null(items, "canonical_url"),
        col_or_null(items, "source_url"), F.col("title")))


def dedupe_last(items: DataFrame, key: str, seq: str) -> DataFrame:
    """Last write per key wins; the key keeps the position of its first row."""
    others = [c for c in items.columns if c != key]
    agg = items.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "").groupBy(key).agg(
        F.max_by(F.struct(*others), F.col(seq)).alias("_last"), F.min(seq).alias("first_position"))
    return agg.select(key, "first_position", *[F.col(f"_last.{c}").alias(c) for c in others])


def hygiene_changes(items: DataFrame) -> DataFrame:
    """Per item: cleaned fields and the reasons to rewrite them.

    Needs id, title, description, price_amount (text or number) and
    price_currency; price_original and price_raw are fallbacks.
    """
    title = F.coalesce(T.clean_title(F.col("title")), F.lit("Untitled"))
    desc = T.clean_description(F.col("description"))
    numeric = dict(items.dtypes)["price_amount"] in ("double", "float", "int", "bigint")
    candidates = {n: F.col(n) for n in ("price_amount", "price_original", "price_raw") if n in items.columns}
    parsed = {f"_{n}": P.price_amount(c.cast("string")) for n, c in candidates.items()}
    staged = pin(items, new_title=title, new_description=desc, **parsed)
    base = staged.withColumns({
        "_current": F.col("_price_amount"), "_resolved": P.first_price({n: F.col(f"_{n}") for n in candidates})})
    value, source = F.col("_resolved.value"), F.col("_resolved.source")
    changed = (F.abs(F.col("_current") - value) > 1e-6) | F.lit(not numeric)
    reasons = F.array_compact(F.array(
        F.when(~F.trim("title").eqNullSafe(F.col("new_title")), "title"),
        F.when(~F.trim("description").eqNullSafe(F.col("new_description")), "description"),
        F.when(value.isNotNull() & F.col("_current").isNull(), F.concat(F.lit("price_repaired:"), source))
        .when(value.isNotNull() & changed, F.concat(F.lit("price_normalized:"), source)),
        F.when(value.isNotNull() & (F.coalesce(F.trim("price_currency"), F.lit("")) == ""), "currency_defaulted"),
        F.when(value.isNull() & F.col("_current").isNull(), "unresolved_invalid_price"),
    ))
    return base.select("id", "new_title", "new_description", value.alias("new_price"), reasons.alias("reasons"))


def hygiene_stats(changes: DataFrame) -> DataFrame:
    """Items per reason kind (the part before any colon)."""
    return (changes.select(F.explode("reasons").alias("reason"))
            .groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("items")))


MISSING_FIELDS = ("description", "dimensions", "material", "color", "brand")


def missing_fields(columns: dict[str, Column]) -> Column:
    """Names of the listed fields that are null or blank, in list order."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", name) for name, c in columns.items()]))
