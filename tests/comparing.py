"""Rows of a Spark query and of DuckDB as comparable text."""

import glob
import os

import duckdb


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value) -> str:
    if value is None or value != value:
        return ""
    return f"{value + 0.0:.6g}" if isinstance(value, float) else str(value)


def rows(names: list[str], values: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted(names), rows(names, got.fetchall())
