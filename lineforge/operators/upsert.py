"""Upsert of a batch into a snapshot by business key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lineforge.operators.columns import quoted, row_hash
from lineforge.operators.dedupe import dedupe_latest

KEY = "polExternalID"
INSERTED_AT = "insertDateTime"
CHANGED_AT = "changedDateTime"


def repeated_keys(batch: DataFrame, key: str = KEY) -> DataFrame:
    """The keys that occur more than once."""
    counted = batch.filter(quoted(key).isNotNull()).groupBy(quoted(key)).agg(F.count("*").alias("__n"))
    return counted.filter("__n > 1").drop("__n")


def latest_lines(
    batch: DataFrame, key: str = KEY, tiebreak: Sequence[Column] = (), repeated: DataFrame | None = None
) -> DataFrame:
    """One row per key of a batch: newest fetch, Closed before Open, last modified.

    Rows without a key are all kept; they never match anything. ``repeated`` are the keys
    that occur more than once, few enough for every task; only their rows are shuffled then.
    """
    order = [
        F.col(INSERTED_AT).desc_nulls_last(),
        F.when(F.col("catOrderStatus") == "Closed", 0).otherwise(1),
        F.col("modifiedDateTime").desc_nulls_last(),
        *tiebreak,
    ]
    if repeated is None:
        return dedupe_latest(batch, [key], order, keep_null_keys=True)
    again = F.broadcast(repeated.select(quoted(key).alias("__again")))
    same = quoted(key) == F.col("__again")
    several = dedupe_latest(batch.join(again, same, "left_semi"), [key], order)
    return batch.join(again, same, "left_anti").unionByName(several)


DUPLICATE = "the batch holds several rows for one key; dedupe it first"


def unique_or_error(batch: DataFrame, key: str = KEY) -> DataFrame:
    """The batch; the job that reads it fails if a non-null key occurs twice."""
    window = Window.partitionBy(quoted(key), _apart(batch, key))
    checked = batch.withColumn("__n", F.count("*").over(window))
    repeated = quoted(key).isNotNull() & (F.col("__n") > 1)
    return checked.filter(
        F.when(repeated, F.raise_error(F.lit(DUPLICATE)).cast("boolean")).otherwise(F.lit(True))
    ).drop("__n")


def _apart(df: DataFrame, key: str) -> Column:
    """0 for rows with a key; rows without one, which match nothing, are spread by their values."""
    return F.when(quoted(key).isNull(), row_hash(df)).otherwise(F.lit(0).cast("bigint"))


def upsert(
    snapshot: DataFrame,
    batch: DataFrame,
    key: str = KEY,
    inserted_at: str = INSERTED_AT,
    changed_at: str = CHANGED_AT,
    checked: bool = False,
) -> DataFrame:
    """The snapshot after the batch.

    A matching row takes every value of the batch row but keeps its own
    ``inserted_at``; ``changed_at`` becomes the batch row's ``inserted_at``. A batch
    row without a match is added with ``changed_at`` null. No row is deleted. Null
    keys never match. Batch keys must be unique, or the job fails; ``checked`` says
    they are.

    One full outer join reads both sides once. Keys are unique, and rows without a
    key are dealt out by their values, so no key gathers more than its two rows.
    """
    by_name = {name.lower(): name for name in batch.columns}
    missing = [
        name
        for name in snapshot.columns
        if name.lower() not in by_name and name.lower() != changed_at.lower()
    ]
    if missing:
        raise ValueError(f"the batch lacks columns of the snapshot: {missing}")
    values = [n for n in snapshot.columns if n.lower() != changed_at.lower()]
    batch = batch.select(*(quoted(by_name[n.lower()]).alias(n) for n in values))
    if not checked:
        batch = unique_or_error(batch, key)

    old = snapshot.select(
        quoted(key).alias("__key"),
        _apart(snapshot, key).alias("__apart"),
        F.struct(*map(quoted, snapshot.columns)).alias("__old"),
    )
    new = batch.select(
        quoted(key).alias("__new_key"),
        _apart(batch, key).alias("__new_apart"),
        F.struct(*map(quoted, values)).alias("__new"),
    )
    same = (F.col("__key") == F.col("__new_key")) & (F.col("__apart") == F.col("__new_apart"))
    joined = old.join(new, same, "full_outer")
    before, after = F.col("__old"), F.col("__new")

    def merged(name: str) -> Column:
        own = before.getField(name)
        if name.lower() == changed_at.lower():
            value = F.when(before.isNotNull() & after.isNotNull(), after.getField(inserted_at))
            return value.otherwise(own)
        if name.lower() == inserted_at.lower():
            return F.when(before.isNull(), after.getField(name)).otherwise(own)
        return F.when(after.isNotNull(), after.getField(name)).otherwise(own)

    return joined.select(*(merged(name).alias(name) for name in snapshot.columns))


def merge_statement(
    table: str,
    batch: str,
    columns: Sequence[str],
    key: str = KEY,
    inserted_at: str = INSERTED_AT,
    changed_at: str = CHANGED_AT,
) -> str:
    """The same upsert as ``MERGE INTO``, for a table format that has it.

    ``batch`` names a view with one row per key. The format then decides which files of
    ``table`` are rewritten.
    """
    changed = [c for c in columns if c.lower() not in (key.lower(), inserted_at.lower(), changed_at.lower())]
    sets = [f"t.`{c}` = s.`{c}`" for c in changed] + [f"t.`{changed_at}` = s.`{inserted_at}`"]
    values = ["NULL" if c.lower() == changed_at.lower() else f"s.`{c}`" for c in columns]
    return (
        f"MERGE INTO {table} t USING {batch} s ON t.`{key}` = s.`{key}`\n"
        f"WHEN MATCHED THEN UPDATE SET {', '.join(sets)}\n"
        f"WHEN NOT MATCHED THEN INSERT ({', '.join(f'`{c}`' for c in columns)}) VALUES ({', '.join(values)})"
    )
