"""Comparison of Spark results with DuckDB results as multisets of rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(sf_dir + "/*.parquet"):
        src = p if os.path.isfile(p) else p + "/*.parquet"
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) > 2**53 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same(df, con, sql):
    """None, or what differs."""
    r = con.sql(sql)
    cols, rows = r.columns, r.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    names = sorted(cols)
    a = sorted(tuple(plain(x[c]) for c in names) for x in df.collect())
    b = sorted(tuple(plain(x[cols.index(c)]) for c in names) for x in rows)
    return None if a == b else f"{len(a)} and {len(b)} rows; only here {[x for x in a if x not in b][:2]}; only there {[x for x in b if x not in a][:2]}"
