"""Cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lineforge.functions.casts import truncated_int
from lineforge.functions.dates import mixed_date_text
from lineforge.functions.defaults import legacy_default, legacy_pso
from lineforge.plans.columns import BRONZE_COLUMNS, DATES, QUANTITIES

RENAMED = {"customerCode": "dealerCode"}


def silver_column(name: str):
    """The cleaned form of one bronze column, under its silver name (upper case)."""
    value, inserted_at = F.col(name), F.col("insertDateTime")
    if name in QUANTITIES:
        clean = truncated_int(value)
    elif name in DATES:
        clean = mixed_date_text(value)
    elif name == "pso":
        clean = legacy_pso(value, inserted_at)
    elif name == "isPurged":
        clean = legacy_default(value, inserted_at, "false")
    elif name == "catOrderStatus":
        clean = legacy_default(value, inserted_at, "Open")
    else:
        clean = F.trim(value)
    return clean.alias(RENAMED.get(name, name).upper())


def silver_parts(bronze: DataFrame) -> DataFrame:
    """All 48 columns cleaned in one projection; a narrower reader prunes the rest."""
    return bronze.select(*map(silver_column, BRONZE_COLUMNS))


def silver_status(statuses: DataFrame) -> DataFrame:
    return statuses.select(
        truncated_int(F.col("sequence")).alias("sequence"), F.trim("status").alias("status")
    )
