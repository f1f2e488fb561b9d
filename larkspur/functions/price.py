"""Price, currency, dimension and bucket expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.folds import let
from larkspur.functions.numbers import js_round

NBSP = "\u00a0"


def _rewrite(c: Column, *rules: tuple[str, str]) -> Column:
    """Apply regex rewrites in order; each step reads the previous one once, so plans stay linear."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def positive(c: Column) -> Column:
    return F.when((c > 0) & (c < F.lit(float("inf"))), c)


def price_amount(c: Column) -> Column:
    """Price text to a positive double: first numeric span, thousands groups and separators resolved.

    The rewrites mark the decimal point as 'd' so that group separators can
    then be removed; a mix that cannot be resolved fails the cast and is null.
    """
    span = F.regexp_extract(F.replace(c, F.lit(NBSP), F.lit(" ")), r"-?\d[\d\s.,]*", 0)
    number = _rewrite(
        span,
        (" ", ""), (r"^-+(?=.*)", "-"), (r"[.,]+$", ""),
        (r"^([^,]*\.[^,]*),([^.,]*)$", "$1d$2"),      # dots group, comma is decimal
        (r"^([^.]*,[^.]*)\.([^.,]*)$", "$1d$2"),      # commas group, dot is decimal
        (r"^(-?\d+)[.,](\d{3})$", "$1$2"),           # a lone separator before three digits groups
        (r"^([^.,d]*)[.,]([^.,d]*)$", "$1d$2"),       # any other lone separator is decimal
        (r"^(?=.*\.)(?=.*,)[^d]*$", "x"),
        ("[.,]", ""), ("d", "."),
    )
    return let(number.try_cast("double"), positive)


def money_sv(c: Column) -> Column:
    """Swedish money text to struct(amount, currency, warnings)."""
    s = F.replace(F.coalesce(F.trim(c), F.lit("")), F.lit(NBSP), F.lit(" "))
    marker = F.lower(F.regexp_extract(s, r"(?i)\b(sek|kr|kronor|eur|usd)\b", 1))
    currency = F.when(marker.isin("sek", "kr", "kronor"), "SEK").when(marker != "", F.upper(marker))
    number = _rewrite(
        s,
        (r"(?i)\b(sek|kr|kronor|eur|usd)\b", ""), (":-", ""), (r"[^0-9,.\-]", ""),
        (r"^(\d+)\.(\d{3})$", "$1$2"),              # lone dot before three digits groups
        (r"\.(?=.*,)|(?<=,\d{0,20})\.", ""),        # with a comma present, dots group
        (",", "."),
    )
    amount = F.when(s != "", number.try_cast("double"))
    warnings = F.array_compact(F.array(
        F.when(s == "", "missing").when(amount.isNull(), "unparseable"),
        F.when(amount <= 0, "non_positive_amount"),
        F.when(amount < 100, "suspiciously_low"),
        F.when(amount > 500000, "suspiciously_high"),
    ))
    return F.struct(amount.alias("amount"), F.when(s != "", currency).alias("currency"), warnings.alias("warnings"))


def resolve_price(candidates: dict[str, Column]) -> Column:
    """First valid price of several candidate texts: struct(value, source)."""
    return first_price({name: price_amount(col.cast("string")) for name, col in candidates.items()})


def first_price(parsed: dict[str, Column]) -> Column:
    """First price that is not null: struct(value, source)."""
    source = None
    for name, value in parsed.items():
        source = F.when(value.isNotNull(), name) if source is None else source.when(value.isNotNull(), name)
    return F.struct(F.coalesce(*parsed.values()).alias("value"), source.alias("source"))


def valid_currency(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).isin("SEK", "KR"), "SEK")


_FOREIGN = r"(?i)(\beur\b|€|\busd\b|\$|\bgbp\b|£|\bdkk\b|\bnok\b|\bchf\b)"
_DOMESTIC = r"(?i)(\bsek\b|\bkr\b|\bkron(a|or)\b)"


def resolve_currency(raw: Column, currency: Column) -> Column:
    """struct(currency, reason): raw text evidence first, then the currency field."""
    foreign, domestic = F.rlike(raw, F.lit(_FOREIGN)), F.rlike(raw, F.lit(_DOMESTIC))
    stated = F.nullif(F.trim(currency), F.lit("")).isNotNull()
    reason = (
        F.when(foreign, "mismatch")
        .when(valid_currency(currency).isNotNull() | domestic, "ok")
        .when(stated, "mismatch").otherwise("unknown")
    )
    return F.struct(F.when(reason == "ok", "SEK").alias("currency"), reason.alias("reason"))


# Upper bounds of the price buckets and their names.
PRICE_BOUNDS = (3000, 8000, 15000, 30000)
PRICE_NAMES = ("budget", "affordable", "mid", "premium", "luxury")


def price_bucket(c: Column, bounds=PRICE_BOUNDS) -> Column:
    expr = F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(None).cast("string"))
    for bound, name in zip(bounds, PRICE_NAMES):
        expr = expr.when(c <= bound, name)
    return expr.otherwise(PRICE_NAMES[-1])


def size_class_from_width(w: Column) -> Column:
    return F.when(w < 180, "small").when(w > 220, "large").otherwise("medium")


def dim_cm(c: Column) -> Column:
    """First number with an optional mm/cm/m unit, in centimetres."""
    text = F.replace(F.lower(c), F.lit(","), F.lit("."))
    pattern = r"(-?\d+(?:\.\d+)?)\s*(mm|cm|m)?(?:[^a-z0-9_]|$)"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    unit = F.regexp_extract(text, pattern, 2)
    return F.when(unit == "mm", number / 10.0).when(unit == "m", number * 100.0).otherwise(number)


def dim_triplet_cm(c: Column) -> Column:
    """'W x H x D unit' to struct(w, h, d) in centimetres; null where it does not match."""
    text = F.replace(F.lower(c), F.lit(","), F.lit("."))
    n = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"{n}\s*[x×]\s*{n}\s*[x×]\s*{n}\s*(mm|cm|m)?"
    unit = F.regexp_extract(text, pattern, 4)

    def part(i):
        v = F.regexp_extract(text, pattern, i).try_cast("double")
        return F.when(unit == "mm", v / 10.0).when(unit == "m", v * 100.0).otherwise(v)

    return F.when(part(1).isNotNull(), F.struct(part(1).alias("w"), part(2).alias("h"), part(3).alias("d")))


def quantity_cm(value: Column, unit: Column) -> Column:
    """Structured quantity to centimetres: metres scale, other units pass through."""
    number = F.replace(F.regexp_replace(value.cast("string"), r"[^\d.,]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.upper(unit).isin("MTR", "M"), number * 100.0).otherwise(number)


def discount_pct(original: Column, current: Column) -> Column:
    return F.when((original > current) & (current > 0), js_round((1.0 - current / original) * 100.0, 1))
