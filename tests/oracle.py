"""Runs a query and its DuckDB twin on the same tables and compares columns, row counts and values, whatever the order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

from tessera.sources.tables import TABLES


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal | int | float):
        x = float(v)
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str, sql: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def differences(df: DataFrame, sf_dir: str, sql: str) -> str:
    """Empty if both agree."""
    columns, rows = duck(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, rows)
    if ours == theirs:
        return ""
    more, less = ours - theirs, theirs - ours
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {sum(more.values())}: {list(more)[:2]}; only theirs {sum(less.values())}: {list(less)[:2]}"
