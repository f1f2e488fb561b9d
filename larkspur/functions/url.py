"""URL expressions by generic-syntax regex; tolerant of non-ASCII paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import contains_any, norm_token

# Fixed value: scheme, authority, path, query and fragment of the generic URI syntax.
URL_RX = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Parameters dropped from canonical urls, and variant selectors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid")
VARIANT_KEYS = ("sku", "variant", "size", "color")


def url_part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, URL_RX, group)


def scheme(c: Column) -> Column:
    return F.lower(url_part(c, 1))


def host(c: Column) -> Column:
    return F.lower(url_part(c, 2))


def path(c: Column) -> Column:
    return url_part(c, 3)


def url_query(c: Column) -> Column:
    return url_part(c, 4)


def path_or_root(c: Column) -> Column:
    return F.coalesce(F.nullif(path(c), F.lit("")), F.lit("/"))


def trim_slash(p: Column) -> Column:
    """Trailing slashes removed unless the path is the root."""
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)


def query_pairs(q: Column) -> Column:
    """key=value strings with a non-empty value."""
    return F.filter(F.split(q, "&"), lambda p: F.rlike(p, F.lit("^[^=]*=.+$")))


def _key(pair: Column) -> Column:
    return F.try_url_decode(F.substring_index(pair, "=", 1))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(c: Column) -> Column:
    """Lower-case host; tracking parameters, blank values and fragment dropped; equal keys grouped."""
    pairs = F.filter(query_pairs(url_query(c)), lambda p: ~F.lower(_key(p)).isin(*TRACKING))
    keyed = F.transform(pairs, lambda p, i: F.struct(
        i.alias("i"), _key(p).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    keys = F.transform(keyed, lambda s: s["k"])
    ordered = F.array_sort(F.transform(keyed, lambda s: F.struct(
        F.array_position(keys, s["k"]).alias("first"), s["i"].alias("i"),
        F.concat(_encode(s["k"]), F.lit("="), _encode(s["v"])).alias("text"))))
    query = F.array_join(F.transform(ordered, lambda s: s["text"]), "&")
    out = F.concat(scheme(c), F.lit("://"), host(c), path_or_root(c),
                   F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme(c).isin("http", "https"), out).otherwise(c)


def canonical_domain(c: Column) -> Column:
    """Host without a leading www.; scheme optional."""
    full = F.when(F.rlike(c, F.lit("^https?://")), c).otherwise(F.concat(F.lit("https://"), c))
    return F.regexp_replace(host(full), r"^www\.", "")


def domains_equivalent(a: Column, b: Column) -> Column:
    strip = lambda d: F.regexp_replace(F.lower(F.trim(d)), r"^www\.", "")
    return strip(a) == strip(b)


def source_url_parts(c: Column) -> Column:
    """struct(normalized, domain, base_url, seed_path, seed_pattern) of a configured source url."""
    text = F.trim(c)
    full = F.when(F.rlike(text, F.lit("^https?://")), text).otherwise(F.concat(F.lit("https://"), text))
    base = F.concat(scheme(full), F.lit("://"), host(full))
    p = path_or_root(full)
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    product = F.filter(segments, lambda s: F.lower(s).isin("p", "product", "produkt", "products", "produkter"))
    pattern = (
        F.when(F.size(segments) == 0, "")
        .when(F.size(product) > 0, F.concat(F.lit("/"), F.try_element_at(product, F.lit(1)), F.lit("/")))
        .otherwise(F.concat(F.lit("/"), F.try_element_at(segments, F.lit(-1))))
    )
    return F.when(host(full) != "", F.struct(
        F.regexp_replace(F.concat(base, p), "/+$", "").alias("normalized"),
        host(full).alias("domain"), base.alias("base_url"),
        F.when(p != "/", p).otherwise("").alias("seed_path"), pattern.alias("seed_pattern")))


def url_key(c: Column) -> Column:
    """Dedup key: scheme, host and path."""
    return F.concat(F.coalesce(F.nullif(scheme(c), F.lit("")), F.lit("https")), F.lit("://"),
                    host(c), trim_slash(path_or_root(c)))


def url_signature(c: Column) -> Column:
    """url_key plus the sorted names of variant parameters; other text lower-cased."""
    raw = F.nullif(F.trim(c), F.lit(""))
    names = F.array_sort(F.filter(F.array_distinct(F.transform(query_pairs(url_query(raw)), lambda p: _key(p))),
                                  lambda k: F.lower(k).isin(*VARIANT_KEYS)))
    names = F.transform(names, F.lower)
    sig = F.concat(url_key(raw), F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise(""))
    return F.when(scheme(raw).isin("http", "https") & (host(raw) != ""), sig).otherwise(F.lower(raw))


def host_key(c: Column) -> Column:
    return norm_token(F.regexp_replace(F.regexp_replace(host(F.trim(c)), r":\d+$", ""), r"^www\.", ""))


def path_key(c: Column) -> Column:
    """Host without www. plus the collapsed path; null where either is empty."""
    p = norm_token(F.regexp_replace(F.regexp_replace(path(F.trim(c)), "/+", "/"), "/$", ""))
    return F.concat(host_key(c), p)


def append_utm(c: Column, content: Column | None = None, source: str = "discovery",
               medium: str = "referral", campaign: str = "beta") -> Column:
    """Outbound link with campaign tags before the fragment, earlier tags replaced; https only."""
    kept = F.filter(F.split(url_query(c), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(
        "utm_source", "utm_medium", "utm_campaign", *(["utm_content"] if content is not None else [])))
    tags = [F.lit(f"utm_source={source}"), F.lit(f"utm_medium={medium}"), F.lit(f"utm_campaign={campaign}")]
    if content is not None:
        tags.append(F.concat(F.lit("utm_content="), F.url_encode(content)))
    fragment = url_part(c, 5)
    out = F.concat(scheme(c), F.lit("://"), host(c), path_or_root(c), F.lit("?"),
                   F.array_join(F.concat(kept, F.array(*tags)), "&"),
                   F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when((scheme(c) == "https") & (host(c) != ""), out)


# Signals that a url serves an image rather than a page.
IMAGE_EXT = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif", ".svg", ".bmp", ".tiff", ".tif", ".ico"]
IMAGE_PATHS = [
    "/images/", "/image/", "/img/", "/media/", "/bilder/", "/foto/", "/photos/", "/pics/", "/product-images/",
    "/product_images/", "/thumbnails/", "/thumb/", "/cdn-cgi/image/", "/pimg/",
]
IMAGE_HOSTS = ["cdn.", "media.", "img.", "images.", "assets.", "static.", "mcdn.", "imgix.", "cloudinary."]
IMAGE_CDN = [".cdn-", ".cdn.", "cloudinary.com", "imgix.net", "shopify.com/cdn"]
IMAGE_QUERY = ["w=", "h=", "width=", "height=", "format=", "quality=", "scale=", "fit=", "crop="]


def _alternatives(terms) -> str:
    return "|".join(t.replace(".", r"\.") for t in terms)


def is_image_url(c: Column) -> Column:
    """Extension, image host, image path or image query parameter."""
    p, h, q, u = F.lower(path(c)), host(c), F.lower(url_query(c)), F.lower(c)
    return F.coalesce(
        (F.length(c) >= 10) & (
            F.rlike(p, F.lit(f"({_alternatives(IMAGE_EXT)})$"))
            | F.rlike(h, F.lit(rf"(^|\.)({_alternatives(IMAGE_HOSTS)})"))
            | contains_any(u, IMAGE_CDN) | contains_any(p, IMAGE_PATHS) | contains_any(q, IMAGE_QUERY)),
        F.lit(False))


def is_truncated_url(c: Column) -> Column:
    """Looks cut off: short or dash-ended last segment without extension, query or fragment."""
    p = F.regexp_replace(path(c), "/+$", "")
    last = F.element_at(F.split(p, "/"), -1)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", True)
        .when((p == "") | (url_query(c) != "") | (url_part(c, 5) != ""), False)
        .when(F.rlike(F.lower(last), F.lit(f"({_alternatives(IMAGE_EXT)})$")), False)
        .when((F.length(last) < 5) & ~F.rlike(last, F.lit(r"^\d+$")), True)
        .otherwise(F.rlike(last, F.lit("[-_]$")))
    )


def absolute_url(u: Column, base: Column) -> Column:
    """Absolute form of a link against a page url."""
    s = F.trim(u)
    root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*[^?#]*/)", 1), F.lit("")),
                        F.concat(root, F.lit("/")))
    return (
        F.when(F.startswith(s, F.lit("//")), F.concat(F.lit("https:"), s))
        .when(F.rlike(s, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), s)
        .when(F.startswith(s, F.lit("/")), F.concat(root, s))
        .otherwise(F.concat(folder, s))
    )


def normalize_images(arr: Column, base: Column) -> Column:
    """Absolute, complete, distinct image urls; if none passes the image test, all are kept."""
    absolute = F.array_distinct(F.filter(
        F.transform(F.filter(arr, lambda u: F.coalesce(u, F.lit("")) != ""), lambda u: absolute_url(u, base)),
        lambda u: ~is_truncated_url(u)))
    good = F.filter(absolute, is_image_url)
    return F.when(F.size(good) > 0, good).otherwise(absolute)


def audit_normal_form(raw: Column) -> Column:
    """Normal form used by list audits; null where no host can be found."""
    s = F.trim(F.regexp_replace(F.trim(raw), r"^[,);]+|[,);]+$", ""))
    full = F.when(F.rlike(s, F.lit("^https?://")), s).otherwise(F.concat(F.lit("https://"), s))
    q = url_query(full)
    out = F.concat(scheme(full), F.lit("://"), host(full), trim_slash(path_or_root(full)),
                   F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when((s != "") & (host(full) != ""), out)
