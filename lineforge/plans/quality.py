"""Quality checks. A check returns the rows that break it; no rows means it holds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lineforge.functions.dates import has_slash, iso_timestamp
from lineforge.functions.predicates import unless

WARN_AFTER_HOURS = 24
ERROR_AFTER_HOURS = 48


def date_format(df: DataFrame, column: str) -> DataFrame:
    """Rows whose date is still written with slashes."""
    return df.filter(has_slash(F.col(column)))


def length(df: DataFrame, column: str, value: int) -> DataFrame:
    """Rows whose text has exactly the forbidden length ``value``."""
    return df.filter(F.length(column) == value)


def string_type(df: DataFrame, column: str) -> DataFrame:
    """One row with count 0 unless some row has a string in ``column``.

    An empty table therefore fails too.
    """
    rows = F.count_if(F.typeof(column) == "string")
    return df.agg(rows.alias("n")).filter("n = 0")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count; nulls are not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n_records"))
        .filter("n_records > 1")
    )


def entry_after_ship(df: DataFrame, entry: str, ship: str) -> DataFrame:
    """Rows entered after they were shipped: shown, not removed."""
    return df.filter(F.col(entry) > F.col(ship))


def drop_ship_after_arrival(df: DataFrame, ship: str, arrival: str) -> DataFrame:
    """Remove rows shipped after their arrival; rows with a missing date stay."""
    return df.filter(unless(F.col(ship) > F.col(arrival)))


def freshness(
    df: DataFrame,
    loaded_at: str,
    as_of: str,
    offset_hours: int = 0,
    warn_after: int = WARN_AFTER_HOURS,
    error_after: int = ERROR_AFTER_HOURS,
) -> DataFrame:
    """Latest load, its age in hours at ``as_of``, and pass, warn or error.

    ``offset_hours`` is how far the load times run ahead of ``as_of``'s clock. Without
    any load time the state is error.
    """
    latest = F.max(iso_timestamp(F.col(loaded_at)))
    seconds = F.lit(as_of).cast("timestamp").cast("bigint") - F.col("latest").cast("bigint")
    return (
        df.agg(latest.alias("latest"))
        .withColumn("age_hours", (seconds + offset_hours * 3600) / 3600.0)
        .withColumn(
            "state",
            F.when(F.col("age_hours") <= warn_after, "pass")
            .when(F.col("age_hours") <= error_after, "warn")
            .otherwise("error"),
        )
    )


@dataclass(frozen=True)
class Check:
    """A check of one column, by kind, with the length for kind ``length``."""

    kind: str
    column: str
    value: int | None = None

    def broken(self) -> Column:
        """Whether a row breaks it, for the kinds that look at one row."""
        column = F.col(self.column)
        if self.kind == "date_format":
            return has_slash(column)
        if self.kind == "length":
            return F.length(column) == self.value
        if self.kind == "not_null":
            return column.isNull()
        raise ValueError(f"check {self.kind} doesn't look at rows one by one")

    def failures(self) -> Column:
        """Number of failures as an aggregate, for the kinds that need no grouping."""
        if self.kind == "string_type":
            return (F.count_if(F.typeof(F.col(self.column)) == "string") == 0).cast("bigint")
        return F.count_if(self.broken())


# Which check applies to which silver column.
PARTS_CHECKS = (
    Check("date_format", "SHIPPEDPGIDATE"),
    Check("date_format", "ORDERENTRYDATE"),
    Check("date_format", "ESTIMATEDSHIPDATE"),
    Check("date_format", "SHIPBYDATE"),
    Check("not_null", "ISPURGED"),
    Check("length", "PSO", 8),
    Check("not_null", "POLEXTERNALID"),
    Check("unique", "POLEXTERNALID"),
    Check("string_type", "CUSTOMERREFERENCE"),
    Check("string_type", "CARRIERNAME"),
    Check("string_type", "CUSTOMERSTORAGELOCATION"),
)
STATUS_CHECKS = (Check("unique", "status"),)


def report(df: DataFrame, checks: Sequence[Check] = PARTS_CHECKS) -> DataFrame:
    """One row per check with its number of failures.

    All checks but ``unique`` share one pass over the columns they name; ``unique``
    needs a grouping by its column, pre-counted per task.
    """
    simple = [check for check in checks if check.kind != "unique"]
    parts = []
    if simple:
        counted = df.agg(*(check.failures().alias(f"c{i}") for i, check in enumerate(simple)))
        lines = F.array(
            *(
                F.struct(
                    F.lit(check.kind).alias("check_name"),
                    F.lit(check.column).alias("column_name"),
                    F.col(f"c{i}").alias("failures"),
                )
                for i, check in enumerate(simple)
            )
        )
        parts.append(counted.select(F.inline(lines)))
    for check in checks:
        if check.kind == "unique":
            repeated = unique(df, check.column)
            parts.append(
                repeated.agg(F.count("*").alias("failures")).select(
                    F.lit(check.kind).alias("check_name"),
                    F.lit(check.column).alias("column_name"),
                    "failures",
                )
            )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("passed", F.col("failures") == 0)
