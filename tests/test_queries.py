"""Every registered query with SQL against DuckDB on the smallest tables; those without at least run."""

import math
import os

import duckdb
import pandas as pd
import pytest

from trailmark.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6g}"
    return str(x)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, D)
    if name in SQL:
        assert rows(got.toPandas()) == rows(con.sql(SQL[name]).df())
    else:
        assert got.count() >= 0
