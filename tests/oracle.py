"""Compares a query's rows with those of its SQL in DuckDB on the same tables."""

from __future__ import annotations

import math
import pathlib
import re

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def _plain(v: object) -> object:
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6))
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "isoformat"):
        return re.sub(r"(T00:00:00)?(\+00:00)?$", "", v.isoformat())
    if hasattr(v, "item"):
        return _plain(v.item())
    if hasattr(v, "tolist") or isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """'' if both hold the same rows under the same names."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    a, b = rows(spark_frame), rows(sql_frame)
    if a == b:
        return ""
    left, right = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only in Spark {str(left)[:700]}; only in SQL {str(right)[:700]}"
