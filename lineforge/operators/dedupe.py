"""Choosing among rows of the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lineforge.operators.columns import quoted, row_hash
from lineforge.operators.joins import join_on


def dedupe_max_max(
    df: DataFrame, keys: Sequence[str], stamp: str = "JOTSTP", sequence: str = "JOSEQN"
) -> DataFrame:
    """Rows whose trimmed stamp and trimmed sequence both equal the key's maxima.

    The maxima are taken independently and as text (``'9'`` is above ``'10'``), so
    a key may keep no row, when they sit on different rows, or several, on ties.

    Maxima are combined per task before they meet. Rows then go to them by key, stamp
    and sequence together, so a frequent key's rows are dealt out by their values and no
    task gathers a key; nothing is held but the one row of maxima.
    """
    tops = df.groupBy(*map(quoted, keys)).agg(
        F.max(F.trim(quoted(stamp))).alias("__stamp"),
        F.max(F.trim(quoted(sequence))).alias("__sequence"),
    )
    equal = {"__stamp": F.trim(quoted(stamp)), "__sequence": F.trim(quoted(sequence))}
    return join_on(df, tops, keys, "inner", null_safe=True, also=equal)


def dedupe_latest(
    df: DataFrame,
    keys: Sequence[str],
    newest_first: Sequence[Column],
    keep_null_keys: bool = False,
) -> DataFrame:
    """One row per key: the first in the order ``newest_first``.

    Filtering on row number 1 lets Spark keep only the best row per key and task
    before the shuffle, so a hot key shrinks to one row per task. The order should
    be total; a hash of the whole row is added last so that a retry picks the
    same row. With ``keep_null_keys`` rows lacking a key are not compared at all.
    """
    complete = F.lit(True)
    for key in keys:
        complete = complete & quoted(key).isNotNull()
    keyed = df.filter(complete) if keep_null_keys else df
    order = [*newest_first, row_hash(df)]
    window = Window.partitionBy(*map(quoted, keys)).orderBy(*order)
    latest = keyed.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")
    return latest.unionByName(df.filter(~complete)) if keep_null_keys else latest
