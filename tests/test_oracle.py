"""Every registered query with oracle SQL must match DuckDB on sf0.001 (and the
rows-only ones must run).  The driver repeats this at sf0.01."""

from __future__ import annotations

import duckdb
import pytest

from conftest import SF_SMALL
from oracle_check import TABLES, rows_of

import __spark_entry__ as E

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def test_contract():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 100


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                          "c_name", "c_mktsegment"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows is not None
        return
    rel = con.sql(ORACLES[name])
    ocols, orows = rel.columns, rel.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert rows_of(cols, rows)[0] == rows_of(ocols, orows)[0]
