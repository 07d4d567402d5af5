"""Compares a query with its SQL twin in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path
from typing import Any

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x: Any) -> Any:
    if isinstance(x, float):
        return None if math.isnan(x) else repr(x)
    if isinstance(x, decimal.Decimal):
        return repr(float(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat(sep=" ")
    return x if x is None or isinstance(x, bool | int) else str(x)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if Path(path).exists():
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if Path(path).is_dir() else ''}')")
    return db


def assert_same(found: DataFrame, sql: str, sf_dir: str) -> None:
    wanted = connect(sf_dir).execute(sql)
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    ours, theirs = rows_of(found.columns, [tuple(r) for r in found.collect()]), rows_of(names, wanted.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
