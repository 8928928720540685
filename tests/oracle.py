"""Compare registered queries with their DuckDB SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        files = glob.glob(path + "/*.parquet") if os.path.isdir(path) else [path]
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return c


def _plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else f"{v:.7g}"
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def compare(spark, c, query, sql: str, sf: str) -> str | None:
    """None when both give the same rows, else what differs."""
    df = query(spark, sf)
    got = c.execute(sql)
    cols = [x[0] for x in got.description]
    theirs = got.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(cols, theirs)
    if a == b:
        return None
    first = next(((x, y) for x, y in zip(a, b) if x != y), (len(a), len(b)))
    return f"{len(a)} and {len(b)} rows; first difference {first}"
