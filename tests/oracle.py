"""Comparison of a query with its SQL on the same tables."""

import decimal
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(d=DATA):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(d):
        path = f"{d}/{f}" if os.path.isfile(f"{d}/{f}") else f"{d}/{f}/*.parquet"
        c.execute(f"create view {f[:-8]} as select * from '{path}'")
    return c


def norm(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows_of(df, columns):
    return sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())


def assert_same(con, df, sql):
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    assert rows_of(df, columns) == want
