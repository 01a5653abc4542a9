"""Runs registered queries against their SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\x00"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str, got_rows=None) -> str | None:
    """None when both sides agree in columns, row count and values; else what differs."""
    got_rows = spark_df.collect() if got_rows is None else got_rows
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want_types = {c[0]: str(c[1]) for c in cur.description}
    want_rows = cur.fetchall()
    got_cols = spark_df.columns
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    got, want = rows_of(got_cols, got_rows), rows_of(want_cols, want_rows)
    if len(got) != len(want):
        return f"row count {len(got)} != {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ, e.g. {sorted(got_cols)} {want_types}\n  spark {str(bad[0][0])[:700]}\n  sql   {str(bad[0][1])[:700]}"
    return None
