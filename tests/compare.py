"""Comparison of a Spark result with DuckDB's, as multisets of rows by column name."""

import datetime
import decimal
import math
import os

import duckdb


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return str([shown(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in sorted(os.listdir(folder)):
        con.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    return con


def assert_same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    want = sorted(tuple(shown(r[i]) for i in at) for r in result.fetchall())
    assert got == want
