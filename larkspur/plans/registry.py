"""Registry: query name -> (DataFrame function, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import ship_package
from larkspur.sources.bindings import Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: str = ""):
    """Register a query over bound tables; `views` names the bindings its oracle SQL reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views.split())
        return fn

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, sf_dir))

        return call

    return {name: bind(fn) for name, fn in QUERIES.items()}
