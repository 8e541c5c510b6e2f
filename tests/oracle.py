"""Compare a query's rows with DuckDB's, as a multiset."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def difference(df, con, sql: str) -> str:
    """'' where both have the same columns, kinds and rows."""
    names = sorted(df.columns)
    ours = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    theirs = [tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall()] if set(names) <= set(columns) else None
    if theirs is None or len(columns) != len(names):
        return f"columns {names} against {sorted(columns)}"
    a, b = Counter(map(repr, ours)), Counter(map(repr, theirs))
    if a != b:
        return f"{len(ours)} rows against {len(theirs)}; only here {list((a - b))[:3]}, only there {list((b - a))[:3]}"
    return ""
