"""Run a registered query and its SQL statement and compare the two results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((x is not None, x or "") for x in r)
    return [columns[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=key
    )


def differences(df, con, sql: str) -> list[str]:
    """Empty if both give the same columns, types of number and rows."""
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    bad = [f"{g} != {w}" for g, w in zip(got, want) if g != w]
    return bad[:5] + ([f"... {len(bad)} rows differ"] if bad else [])
