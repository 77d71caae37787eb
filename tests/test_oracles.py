"""Queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from citegrain.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(table, columns):
    told = lambda v: "~" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(told(r[c]) for c in columns) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toArrow()
    want = duck.execute(catalog.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got, sorted(got.column_names)) == rows(want, sorted(got.column_names))
