"""Catalog tables over external directories.

A table's directory holds one sub-directory per written version and the catalog
points at the current one. A new version is complete before the pointer moves, so
a job may read the table it replaces, and a job that dies while writing leaves the
table as it was. With the schema unchanged the move is a single catalog change. A
changed schema or layout renames twice, old table away and new table in; between the
two the name is missing for a moment, but both tables are there.

A table laid out in buckets is partitioned by the bucket of its key. Rows of some
buckets can then be replaced without touching the files of the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lineforge.operators.columns import quoted, row_hash
from lineforge.session import setting, writing

BUCKET = "key_bucket"
CODEC = {"parquet": {"compression": "zstd"}}
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class Buckets:
    """Layout of a table by key: number of buckets and the column that decides."""

    number: int
    column: str

    def assign(self, df: DataFrame) -> DataFrame:
        """Add each row's bucket; rows without a key are spread by their values."""
        spread = F.pmod(row_hash(df), F.lit(self.number)).cast("int")
        return df.withColumn(BUCKET, F.when(quoted(self.column).isNull(), spread).otherwise(self.of_key()))

    def of_key(self) -> Column:
        """The bucket of a row that has a key."""
        return F.pmod(F.xxhash64(self.column), F.lit(self.number)).cast("int")


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    if not spark.catalog.databaseExists(database):
        where = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")


def _name(database: str, table: str) -> str:
    return f"`{database}`.`{table}`"


def scan_table(spark: SparkSession, table: str, database: str) -> DataFrame:
    return spark.table(_name(database, table))


def table_exists(spark: SparkSession, table: str, database: str) -> bool:
    return spark.catalog.tableExists(_name(database, table))


def overwrite_table(
    df: DataFrame,
    path: str,
    table: str,
    database: str,
    fmt: str = "parquet",
    database_location: str | None = None,
    buckets: Buckets | None = None,
    partition: str | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Replace a table, its schema included; returns the new content.

    With ``buckets`` rows carry the column ``BUCKET`` and a bucket is a directory; its rows
    are written by one task, or by several where adaptive execution finds them too many for
    one (``spark.sql.adaptive.advisoryPartitionSizeInBytes``). Rows that come with their bucket
    and ``dealt`` out by it are not shuffled for it again. With ``partition`` each value of that
    column is one. ``fmt="delta"`` hands the replacement to that format where its classes are on
    the classpath.
    """
    spark = df.sparkSession
    ensure_database(spark, database, database_location)
    name = _name(database, table)
    if fmt == "delta":
        (
            df.write.format(fmt)
            .mode("overwrite")
            .option("overwriteSchema", "true")
            .option("path", path)
            .saveAsTable(name)
        )
        return spark.table(name)
    version = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    exists = table_exists(spark, table, database)
    if buckets is None and partition is None:
        with writing(spark):
            df.write.format(fmt).options(**CODEC.get(fmt, {})).save(version)
        schema = spark.read.format(fmt).load(version).schema
        same = exists and schema.simpleString() == spark.table(name).schema.simpleString()
        if same and not _is_partitioned(spark, table, database):
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
            spark.catalog.refreshTable(name)
            return spark.table(name)
    staged, retired = (_name(database, f"{table}__{uuid.uuid4().hex}") for _ in range(2))
    if buckets is not None:
        rows = df if BUCKET in df.columns else buckets.assign(df)
        # In order of the key within a bucket, so that equal beginnings lie together.
        order = (BUCKET, quoted(buckets.column))
        df = rows if dealt else rows.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(*order)
        partition = BUCKET
    if partition is None:
        spark.catalog.createTable(staged, path=version, source=fmt)
    else:
        writer = df.write.format(fmt).options(path=version, **CODEC.get(fmt, {}))
        with writing(spark):
            writer.partitionBy(partition).saveAsTable(staged)
    if exists:
        spark.sql(f"ALTER TABLE {name} RENAME TO {retired}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    if exists:
        spark.sql(f"DROP TABLE {retired}")
    return spark.table(name)


def _is_partitioned(spark: SparkSession, table: str, database: str) -> bool:
    return any(c.isPartition for c in spark.catalog.listColumns(_name(database, table)))


def partition_values(spark: SparkSession, table: str, database: str) -> list[str]:
    """The values of a table's one partition column, as the catalog lists them."""
    listed = spark.sql(f"SHOW PARTITIONS {_name(database, table)}").collect()
    return [row[0].split("=", 1)[1] for row in listed]


def buckets_in(df: DataFrame) -> list[int]:
    """The buckets that occur in ``df``; never more than the layout has."""
    return sorted(row[0] for row in df.select(BUCKET).distinct().collect())


def replace_buckets(df: DataFrame, table: str, database: str, touched: Sequence[int]) -> DataFrame:
    """Put the rows of ``df`` in place of the buckets they belong to; returns the table.

    Files of other buckets stay as they are. Each bucket is written anew into one file, a
    large one into several of about equal size, so their number does not grow with the number
    of times. New files are complete before any old one goes;
    the exchange itself goes bucket by bucket, so a driver lost in the middle of it leaves
    some buckets old and some new.
    """
    spark = df.sparkSession
    name = _name(database, table)
    rows = df.select(*spark.table(name).columns).hint("rebalance", F.col(BUCKET))
    with setting(spark, OVERWRITE_MODE, "dynamic"), writing(spark):
        rows.write.insertInto(name, overwrite=True)
    spark.catalog.refreshTable(name)
    return spark.table(name)


class SchemaMismatch(ValueError):
    """Rows to append don't fit the table."""


def append_table(
    df: DataFrame,
    path: str,
    table: str,
    database: str,
    fmt: str = "parquet",
    database_location: str | None = None,
) -> DataFrame:
    """Add rows to a table, matched by column name; the first append creates it.

    Columns that only one side has are an error, and so is a type the table's can't hold
    (the write itself says so): nothing is left out or filled with nulls.
    """
    spark = df.sparkSession
    if not table_exists(spark, table, database):
        return overwrite_table(df, path, table, database, fmt, database_location)
    name = _name(database, table)
    columns = spark.table(name).columns
    ours, theirs = ({c.lower() for c in names} for names in (df.columns, columns))
    if ours != theirs:
        raise SchemaMismatch(f"only in the rows: {sorted(ours - theirs)}; only in {name}: {sorted(theirs - ours)}")
    with writing(spark):
        df.select(*map(quoted, columns)).write.insertInto(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def table_location(spark: SparkSession, table: str, database: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_name(database, table)}").filter("col_name = 'Location'")
    return rows.first()["data_type"].rstrip("/")


def drop_old_versions(
    spark: SparkSession, path: str, table: str, database: str, keep: int = 1, older_than_hours: float = 24.0
) -> list[str]:
    """Delete versions below ``path`` the table no longer points at; returns their names.

    The current one stays, so do the ``keep`` newest others and all that are younger than
    ``older_than_hours``, which a job may still be reading.
    """
    current = table_location(spark, table, database).rsplit("/", 1)[-1]
    paths = spark._jvm.org.apache.hadoop.fs
    root = paths.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(root) if s.isDirectory()]
    others = sorted((x for x in found if x[1].startswith("version-") and x[1] != current), reverse=True)
    limit = spark._jvm.java.lang.System.currentTimeMillis() - older_than_hours * 3_600_000
    gone = [name for at, name in others[keep:] if at <= limit]
    for name in gone:
        system.delete(paths.Path(root, name), True)
    return gone
