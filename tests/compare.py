"""Comparing a query with its SQL on the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "null"
        return f"{value + 0.0:.10g}"
    return "null" if value is None else str(value)


def normal_rows(columns: list[str], rows: list) -> list[tuple]:
    """Rows as text, columns by name, sorted, so that order does not matter."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    return sorted(frame.columns), normal_rows(frame.columns, frame.collect())


def sql_rows(connection, text: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(text)
    columns = [d[0] for d in result.description]
    return sorted(columns), normal_rows(columns, result.fetchall())


SQL_TYPES = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def spark_types(frame) -> dict[str, str]:
    return {f.name: SQL_TYPES[f.dataType.simpleString()] for f in frame.schema.fields}


def sql_types(connection, text: str) -> dict[str, str]:
    return {d[0]: str(d[1]) for d in connection.execute(text).description}
