"""Filters whose treatment of nulls differs from plain SQL comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unless(condition: Column) -> Column:
    """True where ``condition`` is false **or unknown**.

    Plain ``NOT (a > b)`` drops rows with a missing side; this keeps them.
    """
    return ~F.coalesce(condition, F.lit(False))
