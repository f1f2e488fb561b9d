"""Stable ids and string hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_sha(c: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def stable_id(source_id: Column, canonical: Column, source_url: Column, title: Column) -> Column:
    """Id from the source and its first identity: canonical url, else url, else title."""
    blank_null = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    identity = F.coalesce(blank_null(canonical), blank_null(source_url), blank_null(title), F.lit(""))
    return short_sha(F.concat(source_id.cast("string"), F.lit("|"), identity))


def string_hash32(c: Column) -> Column:
    """31-multiplier hash over characters with signed 32-bit wrap-around.

    Equals the code-unit rule for text in the basic multilingual plane.
    """
    chars = F.split(c, "")
    wrapped = F.aggregate(
        F.filter(chars, lambda ch: ch != ""), F.lit(0).cast("bigint"),
        lambda acc, ch: (acc * 31 + F.ascii(ch)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    return F.when(wrapped >= F.lit(2**31), wrapped - F.lit(2**32)).otherwise(wrapped)


def hash_bucket(c: Column, mod: int) -> Column:
    """abs(hash) mod n."""
    return F.abs(string_hash32(c)) % F.lit(mod)
