"""Day windows of the incremental fetch, and selection by them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

ORDER_STATUSES = ("Open", "Closed")
DAYS_BACK = 2


def fetch_windows(
    anchor: DataFrame,
    as_of: str = "as_of",
    days_back: int = DAYS_BACK,
    statuses: Sequence[str] = ORDER_STATUSES,
) -> DataFrame:
    """One half-open day window per status, from ``days_back`` days ago to today.

    ``anchor`` holds one row with the date ``as_of``, which may itself be the
    result of an aggregate.
    """
    today = F.col(as_of).cast("date")
    return (
        anchor.select(
            F.explode(F.sequence(F.date_sub(today, days_back), today)).alias("from_date")
        )
        .select(F.explode(F.array(*map(F.lit, statuses))).alias("order_status"), "from_date")
        .withColumn("to_date", F.date_add("from_date", 1))
    )


def within_windows(moment: Column, as_of: date, days_back: int = DAYS_BACK) -> Column:
    """Filter for the windows' days taken together.

    Windows follow each other without a gap, so the whole fetch is one range with
    literal ends, which reaches the scan (row groups, or directories when the
    column partitions the data).
    """
    first, end = as_of - timedelta(days=days_back), as_of + timedelta(days=1)
    return (moment >= F.lit(first)) & (moment < F.lit(end))


def select_windows(
    df: DataFrame,
    moment: str,
    as_of: date,
    days_back: int = DAYS_BACK,
) -> DataFrame:
    """Rows of the fetch windows, with the window's first day as ``from_date``."""
    return df.filter(within_windows(F.col(moment), as_of, days_back)).withColumn(
        "from_date", F.to_date(moment)
    )
