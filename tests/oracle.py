"""Compares a query with its checking SQL: columns, row count and values, whatever the order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def engine(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (int(value) if value == int(value) else value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return int(number) if number == int(number) else number


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=lambda t: tuple((x is not None, str(type(x)), str(x)) for x in t))


def compare(df, con, sql: str) -> str:
    """'' when equal, else what differs."""
    columns, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected_columns, theirs = rows_of(names, cur.fetchall())
    if columns != expected_columns:
        return f"columns {columns} <> {expected_columns}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} <> {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}" if bad else ""
