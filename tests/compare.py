"""Run a query in Spark and its SQL in DuckDB and compare them row by row."""

import math
from pathlib import Path

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, connection, sql: str) -> int:
    """Assert equality and return the number of rows."""
    spark_rows = _rows(df.columns, df.collect())
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    duck_rows = _rows(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(spark_rows) == len(duck_rows), (len(spark_rows), len(duck_rows))
    different = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    assert not different, (len(different), different[:3])
    return len(spark_rows)
