"""Dates and times held as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONTH_FIRST = "MM/dd/yyyy"
STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
PREDICTION_FORMAT = "yyyy-MM-dd HH:mm:ss"


def has_slash(text: Column) -> Column:
    return text.contains("/")


def month_first_date(text: Column) -> Column:
    """Date from ``MM/dd/yyyy`` text, null when it does not parse."""
    return F.try_to_date(text, MONTH_FIRST)


def iso_date(text: Column) -> Column:
    """Date from ISO date or date-time text, null when it does not parse."""
    return F.try_to_date(text)


def iso_timestamp(text: Column) -> Column:
    """Timestamp from ISO text, null when it does not parse."""
    return F.try_to_timestamp(text)


def mixed_date_text(text: Column) -> Column:
    """ISO text of a date that arrives either as ``MM/dd/yyyy`` or already as ISO.

    Text without a slash passes through trimmed and unchecked; a slash date that
    does not parse gives null. The result is always a string, whatever the
    session's ANSI setting.
    """
    return F.when(has_slash(text), month_first_date(text).cast("string")).otherwise(F.trim(text))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``; null when either is missing."""
    return F.date_diff(later, earlier)


def now_or(as_of: str | None) -> Column:
    """The current time, or ``as_of`` (timestamp text) for repeatable runs."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def stamp_text(as_of: str | None, offset_hours: int, pattern: str) -> Column:
    """Time of the run, shifted by ``offset_hours``, as text."""
    return F.date_format(now_or(as_of) + F.make_dt_interval(hours=F.lit(offset_hours)), pattern)
