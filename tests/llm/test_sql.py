"""The corpus queries with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from crawlgauge.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got == sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()))
