"""Comparison of a query with its SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    return value


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(row[n]) for n in names) for row in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(_plain(row[i]) for i in at) for row in result.fetchall()), key=repr)


def differences(df, con, sql: str) -> str:
    """'' if both give the same rows, else what differs."""
    (names, ours), (theirs_names, theirs) = rows_of_spark(df), rows_of_sql(con, sql)
    if names != theirs_names:
        return f"columns {names} against {theirs_names}"
    if ours != theirs:
        a, b = [r for r in ours if r not in theirs][:3], [r for r in theirs if r not in ours][:3]
        return f"{len(ours)} rows against {len(theirs)}; only in Spark {a}; only in SQL {b}"
    return ""
