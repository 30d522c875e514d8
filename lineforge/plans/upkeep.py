"""Silver and gold kept up from a day's changed rows.

What a full build derives from all lines is kept with counts, so that a day's old and new
rows are enough: a pair of carrier code and name is there while its count is above zero, a
center's pending items are a sum from which old rows are taken and to which new ones are
added, and the lines of the fact table are replaced by key. Bronze and silver are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lineforge.plans import quality, silver
from lineforge.plans.gold import REPORT_ROWS
from lineforge.sources.runs import BEFORE

# Bronze columns of the old rows that the counts depend on.
REMEMBERED = ("carrierCode", "carrierName", "facilityName", "orderType", "pendingItemQuantity")
# Those that the checks of silver lines depend on.
CHECKED = ("shippedPGIDate", "orderEntryDate", "estimatedShipDate", "shipByDate", "isPurged", "pso", "polExternalID")
BY_ROW = tuple(c for c in quality.PARTS_CHECKS if c.kind in ("date_format", "length", "not_null"))
CARRIER = ("CARRIERCODE", "CARRIERNAME")
CENTER = ("FACILITYNAME",)
REPORTED_TYPE = "EMERGENCY"
ROWS, VALUES, ITEMS = "n_rows", "n_values", "items"


def _signed(parts: DataFrame, sign: Column) -> DataFrame:
    return parts.withColumn("__sign", sign.cast("bigint"))


def _carriers(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*CARRIER).agg(F.sum("__sign").alias(ROWS))


def _centers(signed: DataFrame) -> DataFrame:
    reported = signed.filter((F.col("ORDERTYPE") == REPORTED_TYPE) & F.col("FACILITYNAME").isNotNull())
    items = F.col("PENDINGITEMQUANTITY").cast("bigint")
    return reported.groupBy(*CENTER).agg(
        F.sum("__sign").alias(ROWS),
        F.coalesce(F.sum(F.when(items.isNotNull(), F.col("__sign"))), F.lit(0)).alias(VALUES),
        F.coalesce(F.sum(items * F.col("__sign")), F.lit(0)).alias(ITEMS),
    )


def carrier_counts(parts: DataFrame) -> DataFrame:
    """Lines of each pair of carrier code and name, of all silver lines."""
    return _carriers(_signed(parts, F.lit(1)))


def center_sums(parts: DataFrame) -> DataFrame:
    """Emergency lines, known quantities and their sum for each center, of all silver lines."""
    return _centers(_signed(parts, F.lit(1)))


def before_and_after(changes: DataFrame, remembered: Sequence[str] = REMEMBERED) -> DataFrame:
    """The silver columns that counts depend on, of new rows with sign 1 and of old ones with -1."""
    columns = [silver.silver_column(c) for c in remembered]
    old = changes.filter(F.col(BEFORE).isNotNull()).select(f"{BEFORE}.*")
    return _signed(changes.select(*columns), F.lit(1)).unionByName(_signed(old.select(*columns), F.lit(-1)))


def _added_up(stored: DataFrame, change: DataFrame, keys: Sequence[str]) -> DataFrame:
    numbers = [c for c in stored.columns if c not in keys]
    both = stored.unionByName(change).groupBy(*keys)
    return both.agg(*(F.sum(c).alias(c) for c in numbers)).filter(F.col(ROWS) != 0)


def carriers_after(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The counts of pairs after a day's changes; pairs without lines go."""
    return _added_up(stored, _carriers(before_and_after(changes)), CARRIER)


def centers_after(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The sums of centers after a day's changes; centers without emergency lines go."""
    return _added_up(stored, _centers(before_and_after(changes)), CENTER)


def dim_carrier(counts: DataFrame) -> DataFrame:
    return counts.select(*CARRIER)


def fact_emergency_order(sums: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    """The report from its sums; a center without any known quantity has a null sum."""
    items = F.when(F.col(VALUES) > 0, F.col(ITEMS))
    return (
        sums.select(
            F.col("FACILITYNAME").alias("DISTRIBUTION_CENTER"),
            F.lit(REPORTED_TYPE).alias("ORDERTYPE"),
            items.alias("COUNT_OF_ITEMS"),
        )
        .orderBy(F.col("COUNT_OF_ITEMS").desc(), F.col("DISTRIBUTION_CENTER"))
        .limit(rows)
    )


def _checks(signed: DataFrame) -> DataFrame:
    broken = [F.sum(F.when(c.broken(), F.col("__sign")).otherwise(0)) for c in BY_ROW]
    sums = [F.sum("__sign"), *broken]
    names = [ROWS, *(f"c{i}" for i in range(len(BY_ROW)))]
    return signed.agg(*(F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, names, strict=True)))


def check_counts(parts: DataFrame) -> DataFrame:
    """One row: the silver lines, and how many break each check that looks at rows one by one."""
    return _checks(_signed(parts, F.lit(1)))


def check_counts_after(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The same after a day's changes, which must remember ``CHECKED``."""
    both = stored.unionByName(_checks(before_and_after(changes, CHECKED)))
    return both.agg(*(F.sum(c).alias(c) for c in stored.columns))


def repeated_keys(parts: DataFrame) -> DataFrame:
    """The keys of silver lines that occur more than once, with their number."""
    return quality.unique(parts, "POLEXTERNALID")


def repeated_keys_after(stored: DataFrame, parts: DataFrame, changes: DataFrame) -> DataFrame:
    """The same after a day's changes.

    Only keys of changed rows are counted again, in the silver lines as they are now; of these
    nothing but the key is read, and the changed keys are few enough to be broadcast to it.
    """
    key = "POLEXTERNALID"
    changed = changes.select(silver.silver_column("polExternalID")).filter(F.col(key).isNotNull()).distinct()
    again = quality.unique(parts.select(key).join(changed, key, "left_semi"), key)
    return stored.join(changed, key, "left_anti").unionByName(again)


def check_report(counts: DataFrame, repeated: DataFrame) -> DataFrame:
    """The report of all checks of silver lines, as ``quality.report`` gives it."""
    both = counts.withColumn("repeated", repeated.agg(F.count("*")).scalar())
    at = {c: F.col(f"c{i}") for i, c in enumerate(BY_ROW)}

    def failures(check: quality.Check) -> Column:
        if check.kind == "unique":
            return F.col("repeated")
        # Silver columns are text; without any row there is none that is.
        return at[check] if check in at else (F.col(ROWS) == 0).cast("bigint")

    lines = F.array(
        *(
            F.struct(
                F.lit(c.kind).alias("check_name"),
                F.lit(c.column).alias("column_name"),
                failures(c).cast("bigint").alias("failures"),
            )
            for c in quality.PARTS_CHECKS
        )
    )
    return both.select(F.inline(lines)).withColumn("passed", F.col("failures") == 0)
