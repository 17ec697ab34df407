"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from crawlgauge import plans

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([norm(v) for v in r]) for r in df.select(*columns).collect())
    found = con.execute(plans.SQL[name])
    assert sorted(d[0] for d in found.description) == columns
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(repr([norm(r[i]) for i in order]) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
