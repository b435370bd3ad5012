"""Registered queries against their DuckDB equivalents, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "clicks"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall())) == sorted(repr(tuple(r)) for r in got.select(cols).collect())
