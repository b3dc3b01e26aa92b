"""Runs a query and its SQL on the same tables and compares columns and rows, in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if v is None or isinstance(v, bool | str):
        return str(v)
    if isinstance(v, float | int) or hasattr(v, "as_integer_ratio"):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6g}" if f != int(f) else str(int(f))
    return str(v)


def compare(df, con, sql: str) -> str:
    """Empty if both agree, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if got == want:
        return ""
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} and {len(want)} rows; query only {sorted(a)[:2]}; SQL only {sorted(b)[:2]}"
