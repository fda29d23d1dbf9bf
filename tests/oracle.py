"""Rows of a query and of its SQL twin in one comparable form."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and v != v):
        return "-"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, list | tuple | np.ndarray):
        return str([cell(x) for x in v])
    if isinstance(v, int | float | np.number):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))
