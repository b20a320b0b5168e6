"""Compares a query's rows with its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(p).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x + 0.0, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differences(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs: column names, row numbers, or the first rows."""
    rel = con.sql(sql)
    names = [c[0] for c in rel.description]
    mine, theirs = rows(df.columns, df.collect()), rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    if len(mine) != len(theirs):
        return [f"{len(mine)} and {len(theirs)} rows: {mine[:2]} and {theirs[:2]}"]
    bad = [f"{a} and {b}" for a, b in zip(mine, theirs) if a != b and not close(a, b)]
    return bad[:3] + ([f"{len(bad)} rows"] if bad else [])


def close(a: tuple, b: tuple) -> bool:
    return all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1.0, abs(x), abs(y)) for x, y in zip(a, b))
