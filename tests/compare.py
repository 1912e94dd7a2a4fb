"""Rows of Spark and of DuckDB in one notation."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def notation(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        value = int(value)
    return repr(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(notation, r)) for r in frame.astype(object).itertuples(index=False, name=None))
