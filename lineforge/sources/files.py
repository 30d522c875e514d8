"""Parquet and delimited-text files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineforge.session import writing


def _given(path: str) -> str:
    if not path:
        raise ValueError("a path is needed")
    return path


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    if not paths:
        raise ValueError("a path is needed")
    return spark.read.parquet(*map(_given, paths))


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Overwrite a directory; returns its content as read back."""
    with writing(df.sparkSession):
        df.write.mode("overwrite").parquet(_given(path), compression=compression)
    return df.sparkSession.read.parquet(path)


def append_parquet(df: DataFrame, path: str) -> DataFrame:
    """Add to a directory; returns its content as read back."""
    df.write.mode("append").parquet(_given(path))
    return df.sparkSession.read.parquet(path)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    infer: bool = False,
    header: bool = True,
    sep: str = "|",
    escape: str = "\\",
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text, all columns string unless a schema is given.

    ``escape`` can be set to a character the data never holds, for sources whose
    fields end in a backslash. Fields with line breaks need ``multi_line``, which
    makes Spark read each file in one task; without it large files are split.
    ``read_records`` reads fields with line breaks from files that are split. ``infer``
    costs a pass over the data.
    """
    reader = spark.read.options(
        header=header, sep=sep, escape=escape, multiLine=multi_line, inferSchema=infer
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(_given(path))


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    header: bool = True,
    sep: str = "|",
    escape: str = "\\",
) -> DataFrame:
    """Delimited text with line breaks inside quoted fields, large files read in parts.

    A line begins a record if the quotes before it in its file are even in number. Quotes
    are counted for each block that a task reads; a running sum over the blocks, a row for
    each, tells the parity at the start of every block, so blocks are cut into records apart
    from each other and only a record that crosses their border is put together from two or
    more. Records are parsed one by one. Quotes must stand around whole fields, doubled or
    after ``escape`` inside; a file that ends inside a quoted field gives that record as far
    as it goes. With ``header`` the first record of every file is left out, and names the
    columns, all text, where no schema is given.
    """
    if schema is None:
        first = spark.read.options(header=header, sep=sep, escape=escape, multiLine=True).csv(_given(path))
        schema = T.StructType([T.StructField(name, T.StringType()) for name in first.columns])
    lines = spark.read.option("lineSep", "\n").text(_given(path)).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    # What follows an escape is no quote that begins or ends a field.
    bare = F.col("line") if escape in ("", '"') else F.regexp_replace("line", f"{re.escape(escape)}.", "")
    quotes = F.length(F.regexp_replace(bare, '[^"]', "")) % 2
    lines = lines.withColumn("odd", quotes)
    inside = Window.partitionBy("file", "block").orderBy("id")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    # For either parity at a block's start, the last line in it that begins a record.
    last = [F.max(F.when(F.col("before") == p, F.col("id"))).alias(f"last{p}") for p in (0, 1)]
    blocks = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"), *last)
    preceding = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("parity", F.coalesce(F.sum("odd").over(preceding), F.lit(0)) % 2)
    begun = F.when(F.col("parity") == 0, F.col("last0")).otherwise(F.col("last1"))
    starts = starts.withColumn("begun", F.when(begun.isNotNull(), F.struct("block", begun.alias("id"))))
    starts = starts.select(
        F.col("file").alias("of_file"),
        F.col("block").alias("of_block"),
        "parity",
        F.last("begun", ignorenulls=True).over(preceding).alias("open"),
    )
    here = (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block"))
    begins = F.col("before") == F.col("parity")
    own = F.max(F.when(begins, F.col("id"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.join(starts, here).withColumn("own", own)
    record = F.when(F.col("own").isNotNull(), F.struct("block", F.col("own").alias("id"))).otherwise(F.col("open"))
    placed = placed.withColumn("record", record)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "id", "line"))), lambda x: x["line"]), "\n")
    records = placed.groupBy("file", "record").agg(text.alias("text"))
    if header:
        # The one record that begins at the first line of its file.
        first_id = F.min("id").alias("first_id")
        heads = lines.where("block = 0").groupBy(F.col("file").alias("head_file")).agg(first_id)
        is_head = (F.col("file") == F.col("head_file")) & (F.col("record.block") == 0) & (F.col("record.id") == F.col("first_id"))
        records = records.join(heads, is_head, "left_anti")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    ddl = ", ".join(f"{quoted_name(f.name)} {f.dataType.simpleString()}" for f in fields)
    options = {"sep": sep, "escape": escape, "multiLine": "true"}
    body = F.regexp_replace("text", "\r$", "")
    return records.where(F.length(body) > 0).select(F.from_csv(body, ddl, options).alias("r")).select("r.*")


def write_delimited(
    df: DataFrame,
    path: str,
    header: bool = True,
    sep: str = "|",
    escape_quotes: bool = False,
    single_file: bool = False,
    most_files: int | None = None,
) -> None:
    """Delimited text with every field quoted.

    Quotes inside a field are written as they are, which a reader cannot undo;
    ``escape_quotes`` makes the file readable again. Files are written in parallel, a task
    for each, and no more than ``most_files`` of them where that is given;
    ``single_file`` sends everything through one task and is for small extracts.
    """
    most = 1 if single_file else most_files
    out = df.coalesce(most) if most else df
    out.write.mode("overwrite").options(
        header=header, sep=sep, quoteAll=True, escapeQuotes=escape_quotes, escape="\\"
    ).csv(_given(path))
