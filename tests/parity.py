"""Spark results against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "as_tuple"):
        return float(value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def compare(spark, folder: str, query, sql: str) -> None:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    found = query(spark, folder)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(_plain(v) for v in r)) for r in found.select(*columns).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(_plain(r[i]) for i in places)) for r in cursor.fetchall())
