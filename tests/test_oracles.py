"""Every query with an SQL twin gives the same rows in DuckDB over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loomstone.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        path = f"{FOLDER}/{f}"
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def comparable(rows: pd.DataFrame) -> list[tuple]:
    def one(v):
        if hasattr(v, "__len__") and not isinstance(v, str | bytes):
            return str([one(x) for x in v])
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return f"{float(v):.6g}" if isinstance(v, float | int) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows[sorted(rows.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    if len(ours) == len(theirs) == 0:
        return
    a, b = ours.copy(), theirs.copy()
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and not pd.api.types.is_bool_dtype(a[c]):
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    assert comparable(a) == comparable(b)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() > 0 and "rrf" in rows.columns
