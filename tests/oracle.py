"""Comparing a query with its SQL on DuckDB."""

import math
import os
from decimal import Decimal

import duckdb


def views(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float | Decimal):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def assert_same(df, sql: str, con) -> int:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(want.columns, want.fetchall())
    return len(got)
