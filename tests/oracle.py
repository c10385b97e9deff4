"""Holds queries against their SQL in DuckDB over the same tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def normal(frame):
    cols = sorted(frame.columns)

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, (float,)) or type(v).__name__.startswith(("float", "int")) or isinstance(v, int) and not isinstance(v, bool):
            return round(float(v), 6)
        return str(v)

    return sorted((tuple(one(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


def check(spark, con, sf, query, sql):
    got, want = query(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
