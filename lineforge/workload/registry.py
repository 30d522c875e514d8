"""Where queries and their SQL checks are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# What a query needs written before it, and the query over that: for timing it alone.
FIXTURES: dict[str, tuple[Callable, Callable]] = {}


def query(name: str, sql: str | None = None, fixture: Callable | None = None) -> Callable:
    """Register a query under ``name``, with the SQL that must give the same rows.

    With ``fixture`` the function takes its result in place of the tables' folder.
    """

    def register(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        if fixture is None:
            QUERIES[name] = fn
        else:
            QUERIES[name] = lambda spark, sf_dir: fn(spark, fixture(spark, sf_dir))
            FIXTURES[name] = (fixture, fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
