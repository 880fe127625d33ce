"""Compare a registered query with its SQL in DuckDB, on the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(d: str):
    con = duckdb.connect()
    for f in sorted(Path(d).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, query, d: str):
    """(problem or None, rows)."""
    df = query.run(spark, d)
    got = df.collect()
    if query.sql is None:
        return None, len(got)
    con = connect(d)
    cur = con.execute(query.sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = _rows(df.columns, [tuple(r) for r in got]), _rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}", len(got)
    return None, len(got)
