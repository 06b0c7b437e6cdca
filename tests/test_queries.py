"""Every query with SQL against DuckDB on the smallest tables: columns, rows and values."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__
from trialspark.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return int(v) if isinstance(v, (int, np.integer)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    asked = tables.execute(SQL[name])
    order = [c[0] for c in asked.description]
    assert sorted(order) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in asked.fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in order]).collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
