"""Run queries on both engines and compare rows, in any order."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def difference(spark, folder: str, query, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    df = query(spark, folder)
    con = connect(folder)
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(theirs_cols):
        return f"columns {df.columns} / {theirs_cols}"
    cols = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    at = [theirs_cols.index(c) for c in cols]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} / {sum(theirs.values())} rows;"
        f" only ours {list(only_ours)[:3]}; only theirs {list(only_theirs)[:3]}"
    )
