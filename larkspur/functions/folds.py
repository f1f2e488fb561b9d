"""Small steps over array values: a named binding, a fold with a named state, and a round-robin spread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Row = Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(items: Column, state: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], done: Callable[[Column], Column]) -> Column:
    """Left fold; `state` names the start values, a step returns the fields that change."""
    def merge(s, x):
        changed = step(s, x)
        return F.struct(*[changed.get(k, s[k]).alias(k) for k in state])

    return F.aggregate(items, F.struct(*[v.alias(k) for k, v in state.items()]), merge, done)


def add(items: Column, *more: Column) -> Column:
    return F.concat(items, F.array(*more))


def tally(items: Column, value: Column) -> Column:
    """How often a value occurs in an array; 0 for a null value."""
    return F.coalesce(F.size(items) - F.size(F.array_remove(items, value)), F.lit(0))


def spread(items: Column, key: Callable[[Row], Column]) -> Column:
    """Round-robin over key buckets, fuller buckets first, then by first appearance; a null key is a bucket of its own."""
    def placed(keys: Column) -> Column:
        def place(row, i):
            own = F.element_at(keys, i + 1)
            return F.struct(tally(F.slice(keys, F.lit(1), i + 1), own).alias("turn"), (-tally(keys, own)).alias("fewer"),
                            F.array_position(keys, own).alias("first"), row.alias("row"))

        return F.transform(F.array_sort(F.transform(items, place)), lambda s: s["row"])

    return let(F.transform(items, lambda row, i: F.coalesce(key(row).cast("string"), F.concat(F.lit("row "), i.cast("string")))), placed)
