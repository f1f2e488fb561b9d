"""Every query runs; those with an oracle equal DuckDB row for row."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from larkspur.sources.bindings import RAW_TABLES
from tests.compare import canonical_rows

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical_rows(got) == canonical_rows(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
