"""File sources: product feeds, sitemaps, page tables and simple item scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_feed_csv(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV feed with a header; every column is read as text.

    With `columns` the schema is fixed and no file is opened while planning. A feed whose quoted fields span lines needs
    multi_line, which makes each file one task; other files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


FEED_JSON_ITEM = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "title", "name", "price", "priceAmount", "currency", "priceCurrency", "url", "link", "sourceUrl",
        "image_url", "imageUrl", "brand", "description", "descriptionShort", "width", "height", "depth",
        "material", "color", "colorFamily", "new_used", "newUsed")
] + [
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))),
    T.StructField("dimensionsCm", T.StructType([T.StructField(n, T.StringType()) for n in "whd"])),
])


def read_feed_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON feed: a top-level list, or a list under `items` or `products`, or one object.

    Feeds with one document per line are split over tasks; a pretty-printed
    document is one record, which needs multi_line and is one task a file.
    """
    schema = T.StructType(
        FEED_JSON_ITEM.fields
        + [T.StructField("items", T.ArrayType(FEED_JSON_ITEM)), T.StructField("products", T.ArrayType(FEED_JSON_ITEM))])
    doc = spark.read.option("multiLine", multi_line).schema(schema).json(path)
    single = F.array(F.struct(*[F.col(f.name) for f in FEED_JSON_ITEM.fields]))
    rows = doc.select(F.explode(F.coalesce("items", "products", single)).alias("r")).select("r.*")
    blank = lambda c: F.nullif(c, F.lit(""))
    return rows.withColumns({
        "image_url": F.coalesce(blank(F.col("image_url")), blank(F.col("imageUrl")), F.try_element_at("images", F.lit(1))["url"]),
        "width": F.coalesce("width", "dimensionsCm.w"),
        "height": F.coalesce("height", "dimensionsCm.h"),
        "depth": F.coalesce("depth", "dimensionsCm.d"),
    }).drop("images", "dimensionsCm", "imageUrl")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, kind): page urls of urlset and plain-text files, child urls of sitemap indexes.

    The XML source splits large files on the row tag; a file without that tag
    yields no rows, so one folder may mix the three formats.
    """
    def locations(row_tag: str, kind: str) -> DataFrame:
        return (spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True)
                .schema("loc string").load(path)
                .select(F.trim("loc").alias("url"), F.lit(kind).alias("kind")).where(F.col("url") != ""))

    lines = spark.read.text(path).select(F.trim("value").alias("url"), F.lit("url").alias("kind"))
    plain = lines.where(F.rlike("url", F.lit(r"^https?://\S+$")))
    return locations("url", "url").unionByName(locations("sitemap", "sitemap")).unionByName(plain)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def active_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("is_active"))


def items_by_ids(items: DataFrame, ids: list | DataFrame) -> DataFrame:
    """Lookup by ids: a list becomes a pushed-down IN filter, a table with `item_id` a semi join."""
    if isinstance(ids, DataFrame):
        return items.join(ids.select("item_id"), "item_id", "left_semi")
    return items.where(F.col("item_id").isin(ids))


def recent_items(items: DataFrame, n: int, order: str = "updated_day") -> DataFrame:
    """Newest n items; planned as TakeOrderedAndProject, never a full sort."""
    return items.orderBy(F.desc(order), F.desc("item_id")).limit(n)
