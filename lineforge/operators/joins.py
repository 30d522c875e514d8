"""Equality joins on equally named columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lineforge.operators.columns import quoted


def join_on(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    null_safe: bool = False,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Columns of ``left``, then those of ``right`` besides the keys.

    ``also`` adds equalities: a column of ``right``, which is left out of the result,
    and what it must equal. Nothing here looks at the data: where a key is frequent,
    adaptive execution splits its rows, for which both sides should come to the join
    without an aggregate of the same key right below it.
    """
    renamed = {key: f"__key{i}" for i, key in enumerate(keys)}
    right = right.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for key, name in renamed.items():
        a, b = left[f"`{key}`"], right[name]
        condition = condition & (a.eqNullSafe(b) if null_safe else a == b)
    for name, column in (also or {}).items():
        condition = condition & (column == quoted(name))
    return left.join(right, condition, how).drop(*renamed.values(), *(also or ()))
