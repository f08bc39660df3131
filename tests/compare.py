"""Compare a Spark result with the SQL result of a second engine."""

from __future__ import annotations

import math
from collections import Counter

TABLES = ("lineitem", "orders", "part", "customer", "supplier", "nation", "region", "events")


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(frame, relation) -> str:
    """Empty if both hold the same columns and the same rows."""
    if sorted(frame.columns) != sorted(relation.columns):
        return f"columns {sorted(frame.columns)} against {sorted(relation.columns)}"
    here = _bag(frame.columns, map(tuple, frame.collect()))
    there = _bag(relation.columns, relation.fetchall())
    if here == there:
        return ""
    return f"only Spark {list((here - there))[:3]}, only SQL {list((there - here))[:3]}"
