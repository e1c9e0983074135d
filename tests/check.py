"""Compare registered queries with their SQL: rows, column names and values."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con




def _rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(lambda r: tuple(map(str, r)), clean.itertuples(index=False)))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else what differs first."""
    ours, theirs = sorted(spark_frame.columns), sorted(sql_frame.columns)
    if ours != theirs:
        return f"columns {ours} != {theirs}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows != {len(sql_frame)}"
    a, b = _rows(_comparable(spark_frame)), _rows(_comparable(sql_frame))
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None


def _comparable(frame: pd.DataFrame) -> pd.DataFrame:
    """Integer columns with NULLs arrive as floats from one side; dates differ in class."""
    out = frame.copy()
    for c in out.columns:
        col = out[c]
        if pd.api.types.is_float_dtype(col) and (col.dropna() % 1 == 0).all():
            out[c] = col.astype("Int64")
        elif pd.api.types.is_integer_dtype(col):
            out[c] = col.astype("Int64")
        elif pd.api.types.is_datetime64_any_dtype(col):
            out[c] = col.astype("datetime64[us]")
        elif col.map(lambda v: hasattr(v, "isoformat")).any():
            out[c] = pd.to_datetime(col).astype("datetime64[us]")
    return out
