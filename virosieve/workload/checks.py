"""Run registered queries against their SQL counterpart in DuckDB."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if math.isnan(value):
            return ""
        return f"{value:.6f}".rstrip("0").rstrip(".") if value else "0"
    return str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    got_columns, got = _table(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    result = con.execute(sql)
    want_columns, want = _table([d[0] for d in result.description], result.fetchall())
    note = f"{len(got)} rows, {spent:.1f}s"
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return False, f"{len(got)} rows, expected {len(want)}"
    if got != want:
        first = next((g, w) for g, w in zip(got, want) if g != w)
        return False, f"first difference: {first}"
    return True, note
