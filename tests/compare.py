"""Compare registered queries with their SQL over the same parquet tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = ("customer", "events", "lineitem", "orders", "part")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value):
    """One form for equal values of both engines; floats are kept exactly."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return (str(type(value)), value)
    if isinstance(value, (int, float)):
        return ("n", "nan" if math.isnan(value) else float(value))
    return ("s", str(value))


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql: str):
    result = con.execute(sql)
    return table([c[0] for c in result.description], result.fetchall())
