"""Compares a Spark query with its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{where}')")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, call, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    got = call(spark, sf_dir)
    left = rows_of(got.columns, map(tuple, got.collect()))
    found = database(sf_dir).execute(sql)
    names = [x[0] for x in found.description]
    right = rows_of(names, found.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows; e.g. {sorted(set(left) ^ set(right), key=repr)[:4]}"
    bad = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(bad)} of {len(left)} rows differ: {bad[:3]}" if bad else ""
