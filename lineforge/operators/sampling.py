"""Holdout and train/test parts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lineforge.operators.columns import quoted

HOLDOUT_ROWS = 10_000
AT_ONCE = 4096  # rows that may be sorted in one task
SKETCH_K = 400  # error of a rank in a sketch: some 0.7 %
MARGINS = (0.0, 0.01, 0.03, 0.1)  # half a bracket's width, as a share of the rows
CHUNK = 7  # bytes of a text that are looked at together
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _cut(df: DataFrame, order: Sequence[str], n: int) -> Column:
    """The smallest of the last ``n`` rows' values of ``order``; null if there are fewer rows.

    Rows are counted by the first column alone, combined per task; the running sum of
    these counts from the newest on tells in which value the cut lies. Only that value's
    rows are then looked at by the other columns, and no more than n of them kept.
    """
    first, *rest = order
    newest = Window.orderBy(F.col(first).desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counts = df.groupBy(first).agg(F.count("*").alias("__n"))
    reached = counts.withColumn("__sum", F.sum("__n").over(newest)).filter(F.col("__sum") >= n)
    edge = reached.agg(F.min(F.struct("__sum", "__n", first))).scalar()
    value, wanted = edge.getField(first), n - edge.getField("__sum") + edge.getField("__n")
    within = df.filter(edge.isNotNull() & F.col(first).eqNullSafe(value)).select(*order)
    by_rest = [F.col(c).desc() for c in rest] or [F.lit(0)]
    last = within.orderBy(*by_rest).limit(n)
    number = F.row_number().over(Window.orderBy(*by_rest))
    chosen = last.withColumn("__k", number).filter(F.col("__k") <= wanted)
    return chosen.agg(F.min(F.struct(*order))).scalar()


def holdout_tail(df: DataFrame, order: Sequence[str], n: int = HOLDOUT_ROWS) -> DataFrame:
    """The last ``n`` rows in ``order``, whose columns together must be unique.

    Nulls come first. Only the cut value is computed; the rows are then found with a
    filter, so nothing but the order columns of the cut's own day is moved.
    """
    cut = _cut(df, order, n)
    return df.filter(cut.isNull() | (F.struct(*order) >= cut))


def holdout_head(df: DataFrame, order: Sequence[str], n: int = HOLDOUT_ROWS) -> DataFrame:
    """All rows but the last ``n``."""
    return df.filter(F.struct(*order) < _cut(df, order, n))


def _key(name: str, dtype: T.DataType, part: int) -> Column:
    """Part ``part`` of a column's values as a long that keeps their order; null stays null.

    Text has a part for every seven bytes: the bytes, zeros where it has ended, and in the
    last three bits how many there are. Other types have one.
    """
    value = quoted(name)
    if isinstance(dtype, _WHOLE):
        return value.cast("long")
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(dtype, T.TimestampNTZType):
        # By the clock, so that no time zone has a say.
        seconds = F.unix_date(value.cast("date")).cast("long") * 86_400 + F.hour(value) * 3600 + F.minute(value) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long")
    if isinstance(dtype, T.StringType):
        piece = F.substring(value.cast("binary"), CHUNK * part + 1, CHUNK)
        digits = F.rpad(F.hex(piece), 2 * CHUNK, "0")
        return F.conv(digits, 16, 10).cast("long") * 8 + F.length(piece)
    raise ValueError(f"no exact cut by {name}: {dtype.simpleString()} is no whole number, date, time or text")


def _literal(value: Any, dtype: T.DataType) -> Column:
    """A value of ``find_cut`` as a constant of the column's type."""
    if value is not None and isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    if value is not None and isinstance(dtype, T.TimestampNTZType):
        return F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=value))).cast(dtype)
    return F.lit(value).cast(dtype)


def _narrowed(keys: DataFrame, wanted: int, at_once: int) -> tuple[int | None, int | None, int, int]:
    """(low, high, wanted, rows): a range of ``k`` in which the cut lies, one value or few rows.

    ``wanted`` rows of the range, counted from its upper end, belong to the tail. Each turn
    takes one sketch and one count of what lies in and above the brackets that it gives. The
    least bracket that the counts confirm is next; a half of the range always is confirmed,
    so the range gets smaller whatever the sketch says. Only numbers reach the driver.
    """
    k = F.col("k")
    rows, low, high, empty = keys.agg(F.count(k), F.min(k), F.max(k), F.count_if(k.isNull())).first()
    if wanted > rows:
        return None, None, wanted - rows, empty
    while rows > at_once and low < high:
        inside = keys.filter(k.between(low, high))
        place = 1 - (wanted - 0.5) / rows
        ranks = [min(max(place + side * m, 0.0), 1.0) for m in MARGINS for side in (-1, 1)]
        sketch = inside.agg(F.kll_sketch_agg_bigint(k, F.lit(SKETCH_K)).alias("s"))
        found = sketch.select(*(F.kll_sketch_get_quantile_bigint("s", F.lit(r)) for r in ranks)).first()
        middle = (low + high) // 2
        ends = set(zip(found[::2], found[1::2], strict=True)) | {(low, middle), (middle + 1, high)}
        ends = sorted(ends - {(low, high)})
        counts = inside.agg(
            *(c for a, b in ends for c in (F.count_if(k > b), F.count_if(k.between(a, b))))
        ).first()
        held = [(counts[2 * i + 1], counts[2 * i], *ends[i]) for i in range(len(ends))]
        rows, above, low, high = min(h for h in held if h[1] < wanted <= h[1] + h[0])
        wanted -= above
    return low, high, wanted, rows


def find_cut(
    df: DataFrame, order: Sequence[str], n: int = HOLDOUT_ROWS, at_once: int = AT_ONCE
) -> tuple[Any, ...] | None:
    """The values of ``order`` in the n-th last row; null if there are fewer rows. Runs jobs.

    For orders whose first column has many values, even one for each row: no window and no
    sort covers the table. Columns are taken one after the other, long text in parts, and
    within each a range is narrowed by quantile sketches and exact counts until it holds at most
    ``at_once`` rows, which are then sorted. Nulls come first. Times are microseconds
    since 1970. Columns may be whole numbers, booleans, dates, timestamps and text.
    """
    if n < 1:
        raise ValueError("a holdout has one row at least")
    types = {name: df.select(quoted(name)).schema[0].dataType for name in order}
    for name in order:
        _key(name, types[name], 0)
    here, wanted, rows = df.select(*map(quoted, order)), n, df.count()
    if n > rows:
        return None
    for name in order:
        for part in count():
            if rows <= at_once:
                break
            key = _key(name, types[name], part)
            low, high, wanted, rows = _narrowed(here.select(key.alias("k")), wanted, at_once)
            here = here.filter(key.isNull() if low is None else key.between(low, high))
            if low is None or not isinstance(types[name], T.StringType) or low & 7 < CHUNK:
                break
    last = here.orderBy(*(quoted(c).desc_nulls_last() for c in order)).limit(min(wanted, at_once))
    first = last.orderBy(*(quoted(c).asc_nulls_first() for c in order)).limit(1)
    times = (T.TimestampType, T.TimestampNTZType)
    plain = [_key(c, types[c], 0) if isinstance(types[c], times) else quoted(c) for c in order]
    return tuple(first.select(*plain).first())


def holdout_parts(
    df: DataFrame, order: Sequence[str], n: int = HOLDOUT_ROWS, at_once: int = AT_ONCE
) -> tuple[DataFrame, DataFrame]:
    """The last ``n`` rows in ``order`` and all others, for any number of different values.

    The same parts as ``holdout_tail`` and ``holdout_head`` give. The cut is found first, by
    ``find_cut``, and then is a constant, so the bound on the first column reaches the scan.
    """
    cut = find_cut(df, order, n, at_once)
    if cut is None:
        return df, df.filter(F.lit(False))
    types = [df.select(quoted(name)).schema[0].dataType for name in order]
    values = list(map(_literal, cut, types))
    first, bound = quoted(order[0]), values[0]
    row, limit = F.struct(*map(quoted, order)), F.struct(*(v.alias(c) for v, c in zip(values, order, strict=True)))
    # Nulls are below every bound; a null bound bounds nothing.
    reaches = F.lit(True) if cut[0] is None else first >= bound
    stays = first.isNull() if cut[0] is None else first.isNull() | (first <= bound)
    return df.filter(reaches & (row >= limit)), df.filter(stays & (row < limit))


def is_test_row(key: str, percent: int = 33, seed: int = 42) -> Column:
    """Repeatable random choice by key: the same row is always on the same side."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 < percent


def split_train_test(
    df: DataFrame, key: str, percent: int = 33, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; disjoint and complete by construction."""
    chosen = F.coalesce(is_test_row(key, percent, seed), F.lit(False))
    return df.filter(~chosen), df.filter(chosen)
