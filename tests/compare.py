"""Runs registered queries against their SQL in DuckDB on one set of tables."""

import datetime
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compared(spark, sf, name, query, sql):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    want = con.sql(sql)
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(want.columns), (name, df.columns, want.columns)
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b), (name, len(a), len(b), a[:3], b[:3])
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (name, len(bad), len(a), bad[:2])
    return len(a), {c: (t, str(dict(zip(want.columns, want.types, strict=True))[c])) for c, t in df.dtypes}
