"""Run a query and its SQL on the same tables and compare the rows, order and row order aside."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{source}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return str(x) if not isinstance(x, (int, float, str)) else x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql: str, sf: str) -> str | None:
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    asked = con.execute(sql)
    names = [d[0] for d in asked.description]
    want = rows_of(names, asked.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 200_000 else []
        lost = [r for r in want if r not in set(got)][:3] if len(want) < 200_000 else []
        return f"{len(got)} and {len(want)} rows; only here {extra}; only there {lost}"
    return None
