"""Rows of a Spark query beside those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from pathlib import Path

import duckdb


def _plain(x):
    if x is None:
        return (0, "")
    if isinstance(x, float):
        return (1, "nan" if math.isnan(x) else f"{x:.9g}")
    return (1, str(x))


def sorted_rows(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {Path(path).stem} AS FROM '{files}'")
    found = con.execute(sql)
    return sorted_rows([d[0] for d in found.description], found.fetchall())


def spark_rows(df):
    return sorted_rows(df.columns, df.collect())
