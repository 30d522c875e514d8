"""Columns by name, whatever the names are."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted name, with underscores put before it until no column has it."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


def without(keep: Sequence[str], results: Iterable[str]) -> list[str]:
    """Kept columns less those named like a result."""
    taken = {r.lower() for r in results}
    return [c for c in keep if c.lower() not in taken]


def narrowed(docs: DataFrame, keep: Sequence[str], text: str, results: str) -> tuple[DataFrame, list[str], str, T.StructType]:
    """What a function over Arrow batches needs and no more.

    The kept columns and the text under a free name, the kept names, that name, and the
    result's schema: kept columns, then ``results``.
    """
    added = T.StructType.fromDDL(results)
    kept = without(keep, added.names)
    (body,) = free_names([*kept, *added.names], "body")
    frame = docs.select(*map(col, kept), col(text).alias(body))
    return frame, kept, body, T.StructType([*(frame.schema[k] for k in range(len(kept))), *added.fields])
