"""Compare a query's Spark result with its SQL run by DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    made = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(made, key=repr)


def connect(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def difference(df, connection, sql):
    """None when both agree, else a short description."""
    got = rows_of(df.columns, df.collect())
    result = connection.execute(sql)
    want = rows_of([column[0] for column in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}; {got[1][:2]} against {want[1][:2]}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{a} against {b}"[:600]
    return None
