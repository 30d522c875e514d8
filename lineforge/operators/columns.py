"""Schema and projection operators; each is a single projection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lineforge.functions.casts import cast_text, truncated_int
from lineforge.functions.dates import (
    STAMP_FORMAT,
    iso_date,
    iso_timestamp,
    month_first_date,
    now_or,
    stamp_text,
)

METADATA_COLUMN = "md_Date"
LOCAL_OFFSET_HOURS = 8

# Replacements in column names, applied once each in this order.
NAME_REPLACEMENTS = (
    (" ", "_"),
    (".", "_"),
    ("[", ""),
    ("]", ""),
    ("(", ""),
    (")", ""),
    ("__", "_"),
    ("\r", ""),
)


def quoted(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; maps count by their entries in order of the keys."""
    return F.xxhash64(
        *(
            F.sort_array(F.map_entries(quoted(f.name))) if isinstance(f.dataType, T.MapType) else quoted(f.name)
            for f in df.schema
        )
    )


def clean_name(name: str) -> str:
    for old, new in NAME_REPLACEMENTS:
        name = name.replace(old, new)
    return name


def clean_columns(df: DataFrame) -> DataFrame:
    """Make column names safe for tables; two names may not become one."""
    names = [clean_name(name) for name in df.columns]
    folded = [name.lower() for name in names]
    clashes = sorted({name for name in names if folded.count(name.lower()) > 1})
    if clashes:
        raise ValueError(f"cleaned column names collide: {clashes}")
    return df.toDF(*names)


def add_metadata(df: DataFrame, source: str, as_of: str | None = None) -> DataFrame:
    """Add the local load time and the name of the source system."""
    loaded = now_or(as_of) + F.expr(f"INTERVAL {LOCAL_OFFSET_HOURS} HOURS")
    return df.withColumns({METADATA_COLUMN: loaded, "SourceSystem": F.lit(source)})


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Trim and cast the schema's columns; other columns stay as they are."""
    return df.withColumns({f.name: cast_text(quoted(f.name), f.dataType) for f in schema})


def _convert(df: DataFrame, columns: Iterable[str], convert) -> DataFrame:
    return df.withColumns({name: convert(quoted(name)) for name in columns})


def to_integer(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text columns to int, cutting off a fraction (see ``truncated_int``)."""
    return _convert(df, columns, truncated_int)


def to_timestamp(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """ISO text columns to timestamp."""
    return _convert(df, columns, iso_timestamp)


def month_first_to_date(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``MM/dd/yyyy`` text columns to date."""
    return _convert(df, columns, month_first_date)


def iso_to_date(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """ISO date or date-time text columns to date."""
    return _convert(df, columns, iso_date)


def nan_to_null(df: DataFrame, skip: Iterable[str] = (METADATA_COLUMN,)) -> DataFrame:
    """NaN to null in the float and double columns, the only ones that can hold it."""
    skipped = {name.lower() for name in skip}
    floats = [
        field.name
        for field in df.schema
        if isinstance(field.dataType, (T.FloatType, T.DoubleType))
        and field.name.lower() not in skipped
    ]
    return _convert(df, floats, lambda c: F.when(~F.isnan(c), c))


def void_to_string(df: DataFrame) -> DataFrame:
    """What has no type for want of values becomes string, inside nested types too."""
    known = {f.name: _without_void(f.dataType) for f in df.schema}
    changed = {f.name: known[f.name] for f in df.schema if known[f.name] != f.dataType}
    return df.withColumns({name: quoted(name).cast(dtype) for name, dtype in changed.items()})


def _without_void(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.NullType):
        return T.StringType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_without_void(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(
            _without_void(dtype.keyType), _without_void(dtype.valueType), dtype.valueContainsNull
        )
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [T.StructField(f.name, _without_void(f.dataType), f.nullable, f.metadata) for f in dtype]
        )
    return dtype


def trim_all(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return _convert(df, text, F.trim)


def stamp_provenance(
    df: DataFrame,
    order_status: str | Column,
    as_of: str | None = None,
    offset_hours: int = LOCAL_OFFSET_HOURS,
) -> DataFrame:
    """Mark fetched lines with the status asked for and the local time of the fetch."""
    status = F.lit(order_status) if isinstance(order_status, str) else order_status
    return df.withColumns(
        {
            "catOrderStatus": status,
            "insertDateTime": stamp_text(as_of, offset_hours, STAMP_FORMAT),
        }
    )


def flatten_structs(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested objects become one column per leaf, named by path; arrays stay arrays."""

    def leaves(column: Column, path: str, dtype: T.DataType):
        if isinstance(dtype, T.StructType):
            for field in dtype:
                yield from leaves(
                    column.getField(field.name), f"{path}{separator}{field.name}", field.dataType
                )
        else:
            yield column.alias(path)

    return df.select(
        *(leaf for f in df.schema for leaf in leaves(quoted(f.name), f.name, f.dataType))
    )


# pandas dtype name to Spark type; anything not listed is text.
PANDAS_TYPES = {
    "datetime64[ns]": T.TimestampType(),
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "float64": T.DoubleType(),
    "float32": T.FloatType(),
    "bool": T.BooleanType(),
}


def schema_from_dtypes(
    dtypes: Mapping[str, object], single_precision: bool = False
) -> T.StructType:
    """Spark schema for a mapping of column to pandas dtype.

    For a pandas frame that exists anyway: ``spark.createDataFrame(pdf,
    schema_from_dtypes(pdf.dtypes))``. ``single_precision`` narrows float64 to
    float, which loses digits and is therefore off by default.
    """
    types = {**PANDAS_TYPES, "float64": T.FloatType()} if single_precision else PANDAS_TYPES
    return T.StructType(
        [T.StructField(name, types.get(str(dtype), T.StringType())) for name, dtype in dtypes.items()]
    )
