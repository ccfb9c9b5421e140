"""Compare a query with its DuckDB counterpart: columns, kinds and rows without order."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, connection, sql: str) -> list:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    ours, theirs = rows(df.columns, df.collect()), rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return [("columns", sorted(df.columns), sorted(names))]
    if len(ours) != len(theirs):
        return [("rows", len(ours), len(theirs), ours[:2], theirs[:2])]
    return [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b][:3]
