"""Rows of a query and of its SQL in one form."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def duck(sf_dir=SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def _value(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(map(_value, r)) for r in df.itertuples(index=False))
