"""Stacking frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_pages(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of the frames, matched by column **name**; absent columns are null.

    Meant for a handful of frames. Many page files belong in one multi-path read,
    which gives a flat plan instead of a chain of unions.
    """
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
