"""Runs a query beside its SQL on the same tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

FOLDER = os.environ.get("QUAYMILL_TEST_DATA", "/root/testdata/sf0.001")


def connect(folder: str = FOLDER):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(f"{float(v):.9g}")


def compare(spark, name, make, sql, con, folder: str = FOLDER) -> None:
    df = make(spark, folder)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if sql is None:
        return
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols, name
    want = sorted(repr(tuple(norm(dict(zip(names, r))[c]) for c in cols)) for r in rel.fetchall())
    assert got == want, name
