"""Text to number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Sign and whole digits of a number; digits may be missing on either side of its point.
_DECIMAL = r"^[\s\p{Cntrl}]*([+-]?)(?=[.\d])(\d*)(?:\.\d*)?[\s\p{Cntrl}]*$"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def truncated_int(text: Column, dtype: T.DataType | None = None) -> Column:
    """Integer part of a plain decimal number, null for anything else.

    ``' 12 '`` gives 12, ``'1.5'`` gives 1, ``'-2.9'`` gives -2, ``'.5'`` gives 0
    and so does a lone point; ``''``, ``'abc'`` and values outside the type give null. White space and
    control characters around the number don't count. Clean integers take the first
    branch and never reach the pattern; others are matched once.
    """
    dtype = dtype or T.IntegerType()
    # The sign, a zero for digits that may be missing, the whole digits; other text stays and is refused again.
    whole = F.regexp_replace(text, _DECIMAL, "$10$2")
    return F.coalesce(text.try_cast(dtype), whole.try_cast(dtype))


def strict_int(text: Column) -> Column:
    """Integer, or null for text that is not a whole number (``'1.5'`` gives null)."""
    return text.try_cast(T.IntegerType())


def cast_text(text: Column, dtype: T.DataType) -> Column:
    """Trim, then cast to ``dtype``; unreadable text gives null."""
    trimmed = F.trim(text)
    if isinstance(dtype, _INTEGRAL):
        return truncated_int(trimmed, dtype)
    return trimmed.try_cast(dtype)
