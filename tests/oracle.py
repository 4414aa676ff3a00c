"""Run a query and its SQL side by side and compare rows exactly."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _value(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def _kind(v):
    return type(v).__name__


def compare(db: duckdb.DuckDBPyConnection, df, sql: str) -> list[str]:
    """Differences between a DataFrame and SQL, empty if there are none."""
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    expected = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    ours = [tuple(r) for r in df.select(*names).collect()]
    problems = []
    if len(ours) != len(expected):
        problems.append(f"rows {len(ours)} vs {len(expected)}")
    for i, name in enumerate(names):
        kinds = [{_kind(r[i]) for r in rows if r[i] is not None} for rows in (ours, expected)]
        if kinds[0] != kinds[1]:
            problems.append(f"types of {name}: {kinds[0]} vs {kinds[1]}")
    key = lambda row: tuple(repr(v) for v in row)
    ours = sorted((tuple(map(_value, r)) for r in ours), key=key)
    expected = sorted((tuple(map(_value, r)) for r in expected), key=key)
    bad = [(a, b) for a, b in zip(ours, expected) if a != b]
    if bad:
        problems.append(f"{len(bad)} differing rows, first {bad[0]}")
    return problems
