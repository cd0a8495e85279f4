"""Order-insensitive comparison of a query with its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql: str) -> str:
    """'' when both agree on columns and rows, else a description."""
    reader = connection.execute(sql)
    names = [d[0] for d in reader.description]
    expected = _rows(names, reader.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return ""
    extra, missing = set(actual) - set(expected), set(expected) - set(actual)
    return (f"{len(actual)} rows <> {len(expected)}; {len(extra)} extra, e.g. {sorted(extra)[:2]}; "
            f"{len(missing)} missing, e.g. {sorted(missing)[:2]}")
