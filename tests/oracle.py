"""Compares a query with its oracle as multisets of rows, columns sorted by name."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows(columns: list[str], data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} and {sorted(names)}"]
    if len(got) != len(want):
        return [f"{len(got)} and {len(want)} rows"]
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return [f"{len(bad)} rows differ, first {str(bad[0])[:700]}"] if bad else []
