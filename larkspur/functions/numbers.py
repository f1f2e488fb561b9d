"""Rounding and numeric coercion as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(c: Column, digits: int = 0) -> Column:
    """Half-up rounding on the double itself: floor(x * 10^n + 0.5) / 10^n."""
    if digits == 0:
        return F.floor(c + F.lit(0.5)).cast("bigint")
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def finite(c: Column) -> Column:
    """Double or null: numeric strings accepted; NaN and infinities become null."""
    d = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def count_true(c: Column) -> Column:
    return F.count_if(c)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))
