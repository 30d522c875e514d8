"""Category text to integer code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# The codes the delivery model was trained on.
TRANSPORT_CODES = {"TRUCK": 1, "AIR": 2}
ORDER_TYPE_CODES = {
    "STOCK": 1,
    "CPRO": 2,
    "FDO": 3,
    "EMERGENCY": 4,
    "WARRANTY": 5,
    "MEGA": 6,
    "DOWN": 7,
    "LCPRO": 8,
}


def encode(value: Column, codes: dict[str, int]) -> Column:
    """Code of ``value``; null for a value without one."""
    entries = F.create_map(*(F.lit(item) for item in chain.from_iterable(codes.items())))
    return F.try_element_at(entries, value)
