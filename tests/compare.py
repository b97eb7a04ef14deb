"""A Spark result against DuckDB's for the same tables, as sorted rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def rows(frame) -> list[tuple]:
    cols = sorted(frame.columns)

    def cell(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "NULL"
        if isinstance(v, float):
            return repr(round(v, 9))
        return str(v)

    def line(values):
        return tuple(cell(float(v)) if c in numeric and not pd.isna(v) else cell(v) for c, v in zip(cols, values, strict=True))

    numeric = {c for c in cols if frame[c].dtype.kind in "fiu" or str(frame[c].dtype) in ("Int32", "Int64")}
    return sorted(line(x) for x in frame[cols].astype(object).values.tolist())
