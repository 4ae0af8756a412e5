"""Compare a Spark result with a DuckDB result, rows in any order."""

import math
from pathlib import Path

import duckdb

TABLES = Path("/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted((TABLES / sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _value(value):
    """A value with its type, so that 1 and 1.0 differ."""
    if isinstance(value, float):
        value = "NaN" if math.isnan(value) else value + 0.0
    return type(value).__name__, value


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(df):
    return normalized(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return normalized([d[0] for d in cursor.description], cursor.fetchall())
