"""Comparison of a query's rows with those of its SQL check."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        file = Path(sf_dir) / f"{table}.parquet"
        connection.execute(f"create view {table} as select * from read_parquet('{file}')")
    return connection


def _bag(rows, order) -> Counter:
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def verdict(frame: DataFrame, duck: duckdb.DuckDBPyConnection, sql: str | None) -> str:
    """``ok ...`` or what differs: column names, rows or values."""
    rows = [tuple(r) for r in frame.collect()]
    if sql is None:
        return f"ok (rows only) {len(rows)}"
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"COLUMNS {sorted(set(names) ^ set(frame.columns))}"
    columns = sorted(names)
    mine = _bag(rows, [frame.columns.index(c) for c in columns])
    theirs = _bag(expected, [names.index(c) for c in columns])
    if mine != theirs:
        extra, missing = list((mine - theirs).items())[:2], list((theirs - mine).items())[:2]
        return f"VALUES {len(rows)} vs {len(expected)} rows; only here {extra}; only there {missing}"
    return f"ok {len(rows)}"
