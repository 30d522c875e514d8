"""Directory layout of the lake: zone, folder, dated landing directories."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineforge.sources.files import read_parquet, write_parquet
from lineforge.sources.tables import overwrite_table

RAW_ZONE = "raw"
BRONZE_ZONE = "bronze"

# URI of a zone; any Hadoop file system will do.
ZONE_URI = "abfss://{zone}@{account}.dfs.core.windows.net"


def zone_path(
    account: str, zone: str, folder: str = "", dataset: str = "", uri: str = ZONE_URI
) -> str:
    """``<zone>/<folder>/<dataset>``; a dataset without a folder is ignored."""
    below = "/".join(part for part in (folder, dataset) if part) if folder else ""
    return f"{uri.format(zone=zone, account=account)}/{below}"


def landing_dataset(entity: str, day: date) -> str:
    return f"{day:%Y%m%d}/{entity}.snappy.parquet"


def land_raw(
    df: DataFrame, account: str, entity: str, day: date, uri: str = ZONE_URI
) -> DataFrame:
    """Write the day's landing directory, replacing an earlier run of that day."""
    path = zone_path(account, RAW_ZONE, entity, landing_dataset(entity, day), uri)
    return write_parquet(df, path, "snappy")


def read_raw(
    spark: SparkSession,
    account: str,
    entity: str,
    days: Iterable[date] | None = None,
    uri: str = ZONE_URI,
) -> DataFrame:
    """Landed rows with their ``landing_date``; only the given days' directories are read."""
    if days is None:
        datasets = [f"*/{entity}.snappy.parquet"]
    else:
        datasets = [landing_dataset(entity, day) for day in days]
    paths = [zone_path(account, RAW_ZONE, entity, dataset, uri) for dataset in datasets]
    day_text = F.regexp_extract(F.col("_metadata.file_path"), rf"/(\d{{8}})/{entity}\.", 1)
    landed = read_parquet(spark, *paths)
    return landed.select("*", F.to_date(day_text, "yyyyMMdd").alias("landing_date"))


def stage_table(
    spark: SparkSession,
    account: str,
    entity: str,
    day: date,
    table: str,
    database: str,
    uri: str = ZONE_URI,
) -> DataFrame:
    """Replace the staging table with the day's landed rows."""
    landed = zone_path(account, RAW_ZONE, entity, landing_dataset(entity, day), uri)
    staged = zone_path(account, BRONZE_ZONE, database, table, uri)
    return overwrite_table(
        read_parquet(spark, landed),
        staged,
        table,
        database,
        database_location=zone_path(account, BRONZE_ZONE, database, uri=uri),
    )
