"""The star schema and the emergency report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lineforge.operators.joins import join_on
from lineforge.plans.columns import FACT_COLUMNS

REPORT_ROWS = 10


def dim_carrier(parts: DataFrame) -> DataFrame:
    """Distinct code and name pairs, the pair of nulls included."""
    return parts.select("CARRIERCODE", "CARRIERNAME").distinct()


def dim_status(status: DataFrame) -> DataFrame:
    return status.select("*")


def fact_parts(parts: DataFrame, status: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Order lines with the code of their status; no carrier name. ``keep`` names more columns to keep.

    A status that is null or not in the lookup gives a null code; a status that is
    in the lookup twice gives two rows. The join carries no hint: Spark broadcasts the
    lookup while its measured size allows, and otherwise splits frequent statuses.
    """
    codes = status.select(F.col("status").alias("STATUS"), F.col("sequence").alias("status_code"))
    joined = join_on(parts, codes, ["STATUS"], "left")
    return joined.select(*(F.col(n).alias(n) for n in (*FACT_COLUMNS, *keep)))


def fact_emergency_order(parts: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    """Distribution centers with the most pending items on emergency orders.

    The column is a sum of quantities in spite of its name. Equal sums are ordered
    by center so that the report is repeatable.
    """
    return (
        parts.filter(F.col("FACILITYNAME").isNotNull())
        .groupBy(F.col("FACILITYNAME").alias("DISTRIBUTION_CENTER"), "ORDERTYPE")
        .agg(F.sum("PENDINGITEMQUANTITY").alias("COUNT_OF_ITEMS"))
        .filter(F.col("ORDERTYPE") == "EMERGENCY")
        .orderBy(F.col("COUNT_OF_ITEMS").desc(), F.col("DISTRIBUTION_CENTER"))
        .limit(rows)
    )
