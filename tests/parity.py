"""Spark against DuckDB: the same rows, columns by name, in any order."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

from scriptorium.sources.tables import SCHEMAS

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in SCHEMAS:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return str(x) if x is not None and not isinstance(x, (int, str, bool)) else x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(((tuple(plain(r[i]) for i in order)) for r in data), key=repr)


def same(spark, query, sql: str, sf_dir: str = SF) -> int:
    """Asserts equal rows; returns how many there are."""
    df = query(spark, sf_dir)
    result = duck(sf_dir).execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    got, expected = rows(df.columns, df.collect()), rows(names, result.fetchall())
    assert len(got) == len(expected), (len(got), len(expected))
    for a, b in zip(got, expected):
        assert a == b, (a, b)
    return len(got)
