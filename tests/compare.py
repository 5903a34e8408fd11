"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(df, sql: str, sf_dir: str) -> str | None:
    """None when equal, else the first difference."""
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    con = views(sf_dir)
    found = con.sql(f"select * from ({sql})")
    if sorted(found.columns) != names:
        return f"columns {names} against {sorted(found.columns)}"
    quoted = ", ".join(f'"{n}"' for n in names)
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"select {quoted} from ({sql})").fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} against {b}"
    return None
