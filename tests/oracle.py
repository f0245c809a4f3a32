"""Compares a query with its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(columns: list[str], found: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in (r[i] for i in order)) for r in found)


def differences(df, sql: str, folder: str) -> tuple[Counter, Counter, int]:
    """Rows that only Spark has, those that only DuckDB has, and how many there are."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection(folder).execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)
    return got - want, want - got, sum(got.values())
