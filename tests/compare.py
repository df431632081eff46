"""Spark results against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def _cell(v):
    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


def same(spark_frame, sql: str, con) -> None:
    got, want = spark_frame.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
