"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "is_integer") and not isinstance(v, int):
        f = float(v)
        if math.isnan(f):
            return None
        return 0.0 if f == 0 else f
    if isinstance(v, int):
        return float(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, entry, sf_dir: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(set(df.columns) ^ set(cols))}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "empty"
    if a != b:
        names = sorted(cols)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        x, y = bad[0]
        diff = {n: (p, q) for n, p, q in zip(names, x, y) if p != q}
        return f"{len(bad)}/{len(a)} rows differ, e.g. {diff} in {dict(zip(names, x))}"
    return None
