"""Repairs that apply to legacy lines only: those without an insert time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PADDED_FROM = 8


def legacy_pso(pso: Column, inserted_at: Column) -> Column:
    """Put a zero in front of an eight-character number of a legacy line.

    The length is taken on the trimmed text but the zero goes before the text as
    it came; other numbers are trimmed.
    """
    short = (F.length(F.trim(pso)) == PADDED_FROM) & inserted_at.isNull()
    return F.when(short, F.concat(F.lit("0"), pso)).otherwise(F.trim(pso))


def legacy_default(value: Column, inserted_at: Column, default: str) -> Column:
    """``default`` for a missing value of a legacy line, else the trimmed value."""
    missing = value.isNull() & inserted_at.isNull()
    return F.when(missing, F.lit(default)).otherwise(F.trim(value))
