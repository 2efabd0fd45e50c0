"""Compares a query's rows with those of its SQL on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"


def engine():
    duckdb = pytest.importorskip("duckdb")
    files = glob.glob(f"{DATA}/*.parquet")
    if not files:
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in files:
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df: pd.DataFrame) -> list:
    def show(x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return ""
        return str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return [sorted(df.columns), *sorted(tuple(show(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))]


def same(spark, con, query, sql):
    assert plain(query(spark, DATA).toPandas()) == plain(con.sql(sql).df())
