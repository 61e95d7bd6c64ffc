"""Side-by-side check of a registered query against its DuckDB oracle."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from ..session import TABLES, table_path
from .registry import load_all


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<nan>"
        return repr(round(v, 5) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    q = load_all()[name]
    got = q.build(spark, sf_dir).toPandas()
    out = {"query": name, "spark_rows": len(got), "cols": sorted(got.columns)}
    if q.sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    want = con.execute(q.sql).fetchdf()
    out["oracle_rows"] = len(want)
    if sorted(got.columns) != sorted(want.columns):
        out["status"] = f"column mismatch: {sorted(want.columns)}"
        return out
    a, b = canon(got), canon(want)
    if a == b:
        out["status"] = "match"
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["status"] = "value mismatch"
        out["diff"] = diff
    return out
