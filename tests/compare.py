"""Compares a query's rows with those of its DuckDB SQL."""

from __future__ import annotations

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(frame, sf_dir: str, sql: str) -> str:
    """'' if the rows are equal, else what differs."""
    columns, rows = duck(sf_dir, sql)
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} and {sorted(columns)}"
    order = sorted(columns)
    want = Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in rows)
    got = Counter(tuple(plain(r[c]) for c in order) for r in frame.select(order).collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows for {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]} ({order})"
