"""Compares a query's rows with those of its SQL in DuckDB, without order."""

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


def assert_same(df, con, sql):
    want = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    have = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    expected = Counter(tuple(norm(r[i]) for i in at) for r in want.fetchall())
    assert have == expected, (list((have - expected).items())[:3], list((expected - have).items())[:3])
