"""Compares a registered query with its DuckDB form on the given tables."""

from __future__ import annotations

import decimal
import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = pathlib.Path(folder) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else the first difference."""
    got_cols, got = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    want_cols, want = [c[0] for c in res.description], res.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(_rows(got_cols, got), _rows(want_cols, want)):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"columns {sorted(got_cols)}\n  spark {str(a)[:600]}\n  sql   {str(b)[:600]}"
    return None
