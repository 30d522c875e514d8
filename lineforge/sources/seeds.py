"""Seed lookups from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineforge.session import constant_rows
from lineforge.sources.tables import overwrite_table

SEED_SCHEMA = "sequence string, status string"

# The status lookup.
STATUSES = [
    ("1", "Future Dated"),
    ("2", "ESD Needed"),
    ("6", "Cancelled"),
    ("4", "Sourced"),
    ("5", "Shipped"),
    ("7", "Griefed"),
    ("0", "Null"),
]


def write_status_seed(spark: SparkSession, path: str) -> str:
    """Put the status lookup as a CSV file where all executors can read it."""
    rows = constant_rows(spark, STATUSES, "sequence", "status")
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_seed(spark: SparkSession, path: str, schema: str = SEED_SCHEMA) -> DataFrame:
    """Seed rows as text; a byte order mark is dropped by the reader."""
    return spark.read.schema(schema).option("header", True).csv(path)


def load_seed(
    spark: SparkSession,
    path: str,
    table_path: str,
    table: str,
    database: str,
    schema: str = SEED_SCHEMA,
    database_location: str | None = None,
) -> DataFrame:
    """Replace the seed's table with the file's rows."""
    return overwrite_table(
        read_seed(spark, path, schema),
        table_path,
        table,
        database,
        database_location=database_location,
    )
