"""Spark results against DuckDB results, without regard to the order of rows."""

import glob
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())


def sql_rows(sql, folder):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = con.sql(sql)
    names = list(got.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(repr(tuple(plain(r[i]) for i in order)) for r in got.fetchall())
