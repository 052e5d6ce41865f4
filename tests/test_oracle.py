"""Each query with SQL against DuckDB on the smallest tables; each without runs and has rows."""

import math
import os

import duckdb
import pytest

from fieldstream import plans

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, oracle, name):
    df = plans.QUERIES[name](spark, SF)
    result = oracle.execute(plans.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
