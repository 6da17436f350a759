"""Queries against their SQL in DuckDB."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6))
    try:
        return repr(round(float(v), 6)) if type(v).__name__ == "Decimal" else str(v)
    except ValueError:
        return str(v)


def compare(spark, con, query, sql, folder=DATA):
    got = query(spark, folder)
    names = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    b = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert a == b


def filled(df):
    """For queries that SQL cannot express, beside their own tests: rows come out, none twice, and no column is empty."""
    rows = [tuple(map(repr, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
    for i, c in enumerate(df.columns):
        assert any(r[i] != "None" for r in rows), c
