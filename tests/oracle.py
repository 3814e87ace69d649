"""Runs a query and its SQL over one folder of tables and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def available() -> bool:
    return Path(SF, "documents.parquet").exists()


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return tuple(map(_cell, x)) if isinstance(x, (list, tuple)) else x


def same(spark, query, sql: str) -> None:
    got = query(spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(sql)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted((tuple(_cell(r[c]) for c in cols) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(_cell(r[i]) for i in at) for r in want.fetchall()), key=repr)
