"""``NOT IN`` without a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lineforge.operators.columns import quoted
from lineforge.operators.joins import join_on


def null_aware_guard(excluded: DataFrame, key: str):
    """SQL's three cases of ``key NOT IN excluded`` as a filter on the outer row.

    Nothing excluded: every row passes, null keys too. A null among the excluded:
    no row passes. Otherwise rows without a key fail. Both counts come from one
    aggregate, used as scalar subqueries.
    """
    total = excluded.agg(F.count("*")).scalar()
    nulls = excluded.agg(F.count_if(quoted(key).isNull())).scalar()
    return (total == 0) | ((nulls == 0) & quoted(key).isNotNull())


def stored_guard(table: DataFrame, key: str):
    """The same for a stored table, whose keys are not read for it.

    A row of each split tells whether there are any. Whether a key is null is a filter
    that the files' own statistics answer: blocks without nulls are passed over.
    """
    some = table.select(F.lit(1).alias("__one")).limit(1).agg(F.count("*")).scalar()
    nulls = table.filter(quoted(key).isNull()).select(quoted(key)).limit(1).agg(F.count("*")).scalar()
    return (some == 0) | ((nulls == 0) & quoted(key).isNotNull())


def not_in(
    df: DataFrame, excluded: DataFrame, key: str, guard_on: DataFrame | None = None
) -> DataFrame:
    """Rows of ``df`` whose ``key`` is ``NOT IN`` the ``key`` column of ``excluded``.

    Spark plans SQL's ``NOT IN`` as a broadcast of the subquery, which fails once
    the excluded side has grown. This is an ordinary left anti join on the key
    behind a null guard: Spark may shuffle it or, when the excluded keys are small
    at run time, broadcast it. Both sides reach the join straight from their shuffle,
    so adaptive execution can split the rows of a frequent key.

    When ``excluded`` has already been reduced to keys that can match, the whole
    set goes in ``guard_on``, for the guard depends on all of it; that is a stored table.
    """
    keys = excluded.select(quoted(key)).filter(quoted(key).isNotNull())
    guard = null_aware_guard(excluded, key) if guard_on is None else stored_guard(guard_on, key)
    guarded = df.filter(guard)
    return join_on(guarded, keys, [key], "left_anti")
