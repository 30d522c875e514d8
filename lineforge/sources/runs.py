"""A keyed table as a base and a few runs of changed rows.

An upsert writes a run: the batch's rows as they are after it, and nothing else. The table's
content is the newest run's rows of each key, and the base's rows of all keys that no run
holds. So a day writes data in proportion to its batch, and the base's files stay as they
are until ``compact`` folds the runs into a new base. A base that was folded gives the same
content while the runs are still there, so a job that dies between the two steps does no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lineforge.operators.columns import quoted
from lineforge.operators.upsert import CHANGED_AT, INSERTED_AT, unique_or_error
from lineforge.session import run_dir, writing
from lineforge.sources.files import write_parquet
from lineforge.sources.tables import (
    BUCKET,
    Buckets,
    overwrite_table,
    partition_values,
    scan_table,
    table_exists,
    table_location,
)

RUN = "run"
BEFORE = "__before"
MOST_SENT = 250_000  # changed keys that every task may get
MOST_MARKED = 1 << 30  # rows of which every task may get a bit each
LEAST_KEPT = 1 << 20  # bytes of a base's file whose rows stay together when runs are folded
FILE_SIZE = "__size"


@dataclass(frozen=True)
class RunTable:
    """Where the base and the runs are: ``table`` and ``<table>_runs``, below ``path``.

    ``buckets`` lays the base out by key. Rows without a key match nothing.
    """

    table: str
    database: str
    path: str
    key: str
    location: str | None = None
    buckets: Buckets | None = None

    @property
    def runs_table(self) -> str:
        return f"{self.table}_runs"

    def exists(self, spark: SparkSession) -> bool:
        return table_exists(spark, self.table, self.database)

    def create(self, df: DataFrame, dealt: bool = False) -> DataFrame:
        """Replace base and runs by these rows, which may come ``dealt`` out by bucket; returns the content."""
        spark = df.sparkSession
        overwrite_table(
            df, self.path, self.table, self.database,
            database_location=self.location, buckets=self.buckets, dealt=dealt,
        )
        self._clear_runs(spark)
        return self.content(spark)

    def _clear_runs(self, spark: SparkSession) -> None:
        nothing = self.base(spark).filter("false").withColumn(RUN, F.lit(0))
        overwrite_table(
            nothing, f"{self.path.rstrip('/')}_runs", self.runs_table, self.database,
            database_location=self.location, partition=RUN,
        )

    def base(self, spark: SparkSession) -> DataFrame:
        return scan_table(spark, self.table, self.database).drop(BUCKET)

    def runs(self, spark: SparkSession) -> DataFrame | None:
        """All runs' rows with the number of their run; null where there never was one."""
        if not table_exists(spark, self.runs_table, self.database):
            return None
        return scan_table(spark, self.runs_table, self.database)

    def numbers(self, spark: SparkSession) -> list[int]:
        """Numbers of the runs, from the catalog."""
        if not table_exists(spark, self.runs_table, self.database):
            return []
        return sorted(map(int, partition_values(spark, self.runs_table, self.database)))

    def version(self, spark: SparkSession) -> str:
        """A text that changes with every change of the table."""
        if not self.exists(spark):
            return ""
        return f"{table_location(spark, self.table, self.database)} {self.numbers(spark)}"

    def content(self, spark: SparkSession) -> DataFrame:
        """The table's rows.

        The base's rows are not shuffled, see ``_current``. Of runs with few rows a task passes
        on only the newest row of each key; a single run is not shuffled.
        """
        base, numbers = self.base(spark), self.numbers(spark)
        if not numbers:
            return base
        names = [quoted(c) for c in base.columns]
        unchanged, changed = self._current(spark, numbers)
        return unchanged.select(*names).unionByName(changed.select(*names))

    def _current(self, spark: SparkSession, numbers: list[int]) -> tuple[DataFrame, DataFrame]:
        """The base's rows whose key no run holds, with ``FILE_SIZE``, and the runs' newest rows of their keys.

        Up to ``MOST_SENT`` changed keys go to every task. Of more, only keys meet, each with
        its file and its place there; a row of the base or a run that a later run replaces is
        then one bit, and the bits go to every task, an eighth of a byte for each row. Above
        ``MOST_MARKED`` rows the base and the changed keys are shuffled. Rows without a key are all current.
        """
        key = quoted(self.key)
        base = scan_table(spark, self.table, self.database).select("*", F.col("_metadata.file_size").alias(FILE_SIZE))
        runs = self.runs(spark)
        n_changed = runs.count()
        if MOST_SENT < n_changed and self.base(spark).count() + n_changed <= MOST_MARKED:
            return self._not_marked(spark, numbers)
        changed = runs.select(key.alias("__changed")).filter("__changed is not null").distinct()
        same = key == F.col("__changed")
        unchanged = base.join(F.broadcast(changed) if n_changed <= MOST_SENT else changed, same, "left_anti")
        keyed = runs.filter(key.isNotNull())
        if len(numbers) > 1:
            newest = F.rank().over(Window.partitionBy(key).orderBy(F.col(RUN).desc()))
            keyed = keyed.withColumn("__newest", newest).filter("__newest = 1").drop("__newest")
        return unchanged, keyed.unionByName(runs.filter(key.isNull()))

    def _not_marked(self, spark: SparkSession, numbers: list[int]) -> tuple[DataFrame, DataFrame]:
        """The rows of the base and of the runs without those that a later run replaces."""
        key = quoted(self.key)
        # Blocks and bits are counted from 1 by the bitmap functions.
        at = F.col("_metadata.row_index") + 1
        place = [
            F.col("_metadata.file_path").alias("__file"),
            F.bitmap_bucket_number(at).alias("__block"),
            F.bitmap_bit_position(at).alias("__bit"),
        ]
        size = F.col("_metadata.file_size").alias(FILE_SIZE)
        base = scan_table(spark, self.table, self.database).select("*", size, *place)
        runs = self.runs(spark).select("*", *place)
        replaced = (key == F.col("__changed")) & (F.col("__run") < F.col("__last"))
        last = runs.filter(key.isNotNull()).groupBy(key.alias("__changed")).agg(F.max(RUN).alias("__last"))
        spots = ["__file", "__block", "__bit"]
        earlier = base.select(key, F.lit(0).alias("__run"), *spots)
        if len(numbers) > 1:
            older = runs.filter(F.col(RUN) < max(numbers))
            earlier = earlier.unionByName(older.select(key, F.col(RUN).alias("__run"), *spots))
        marks = (
            earlier.join(last, replaced, "left_semi")
            .groupBy(F.col("__file").alias("__in"), F.col("__block").alias("__of"))
            .agg(F.bitmap_construct_agg("__bit").alias("__marks"))
        )
        byte = F.expr("ascii(decode(substring(__marks, cast(__bit div 8 as int) + 1, 1), 'ISO-8859-1'))")
        marked = F.expr("cast(__bit % 8 as int)")
        here = (F.col("__file") == F.col("__in")) & (F.col("__block") == F.col("__of"))
        stays = F.col("__marks").isNull() | (F.call_function("shiftright", byte, marked) % 2 == 0)
        spare = [*spots, "__in", "__of", "__marks"]
        unchanged, changed = (
            rows.join(F.broadcast(marks), here, "left").filter(stays).drop(*spare) for rows in (base, runs)
        )
        return unchanged, changed

    def append_run(self, rows: DataFrame, ordered: bool = False) -> None:
        """Add rows as a new run, each file sorted by key; they must replace all rows of their keys.

        With ``ordered`` they are read from files that are.
        """
        spark = rows.sparkSession
        names = [quoted(c) for c in self.base(spark).columns]
        rows = rows.select(*names)
        rows = rows if ordered else rows.sortWithinPartitions(quoted(self.key))
        if self._fits(rows):
            self._add_run(rows)
            return
        # The table's own write decides whether it can hold them.
        number = self._next_run(spark)
        name = f"`{self.database}`.`{self.runs_table}`"
        with writing(spark):
            rows.withColumn(RUN, F.lit(number)).write.insertInto(name)
        spark.catalog.refreshTable(name)

    def _next_run(self, spark: SparkSession) -> int:
        if not table_exists(spark, self.runs_table, self.database):
            self._clear_runs(spark)
        return max(self.numbers(spark), default=0) + 1

    def upsert(
        self,
        batch: DataFrame,
        inserted_at: str = INSERTED_AT,
        changed_at: str = CHANGED_AT,
        remember: Sequence[str] = (),
        checked: bool = False,
        stored: bool = False,
    ) -> DataFrame:
        """Write the batch as a run; returns its rows as they are now.

        The same rule as ``operators.upsert``: a matching row keeps its ``inserted_at`` and
        gets the batch's as ``changed_at``, a new one has no ``changed_at``, null keys never
        match, batch keys must be unique. Of the table only the key, ``inserted_at`` and the
        columns in ``remember`` are read. The result has one more column, ``BEFORE``: the
        struct of the remembered columns before the batch, null where the row is new. A batch
        that is ``stored``, hardly more than a scan of files, is not written for it again.
        """
        spark = batch.sparkSession
        columns = self.base(spark).columns
        by_name = {name.lower(): name for name in batch.columns}
        values = [n for n in columns if n.lower() != changed_at.lower()]
        missing = [n for n in values if n.lower() not in by_name]
        if missing:
            raise ValueError(f"the batch lacks columns of the table: {missing}")
        batch = batch.select(*(quoted(by_name[n.lower()]).alias(n) for n in values))
        batch = batch if stored else write_parquet(batch, run_dir(spark, "batch"))
        if not checked:
            # Only keys are shuffled for it; the table is not written to before.
            known_keys = batch.select(quoted(self.key)).filter(quoted(self.key).isNotNull())
            unique_or_error(known_keys, self.key).count()
        keys = batch.select(quoted(self.key).alias("__wanted")).filter("__wanted is not null")
        names = list(dict.fromkeys([inserted_at, *remember]))
        kept = self.content(spark).select(
            quoted(self.key).alias("__key"), F.struct(*map(quoted, names)).alias(BEFORE)
        )
        known = kept.join(keys, F.col("__key") == F.col("__wanted"), "left_semi")
        joined = batch.join(known, batch[f"`{self.key}`"] == F.col("__key"), "left")
        matched = F.col("__key").isNotNull()

        def after(name: str) -> Column:
            if name.lower() == changed_at.lower():
                return F.when(matched, quoted(inserted_at)).alias(name)
            if name.lower() == inserted_at.lower():
                return F.when(matched, F.col(BEFORE).getField(inserted_at)).otherwise(quoted(name)).alias(name)
            return quoted(name)

        rows = joined.select(*map(after, columns), F.when(matched, F.col(BEFORE)).alias(BEFORE))
        # The join leaves them in this order, unless the snapshot's side was broadcast.
        rows = rows.sortWithinPartitions(quoted(self.key))
        if self._fits(rows.drop(BEFORE)):
            return self._add_run(rows)
        changes = write_parquet(rows, run_dir(spark, "changes"))
        self.append_run(changes.drop(BEFORE), ordered=True)
        return changes

    def _fits(self, rows: DataFrame) -> bool:
        """Whether rows have the table's types, so that their files can be its own."""
        return [f.dataType for f in rows.schema] == [f.dataType for f in self.base(rows.sparkSession).schema]

    def _add_run(self, rows: DataFrame) -> DataFrame:
        """Write rows of the table's types as a run, there once all its files are; returns them as written.

        Columns the table doesn't have lie in the run's files too, and are read only from the result.
        """
        spark = rows.sparkSession
        number = self._next_run(spark)
        path = f"{table_location(spark, self.runs_table, self.database)}/{RUN}={number}"
        written = write_parquet(rows, path)
        if not written.isEmpty():
            name = f"`{self.database}`.`{self.runs_table}`"
            spark.sql(f"ALTER TABLE {name} ADD PARTITION ({RUN}={number}) LOCATION '{path}'")
            spark.catalog.refreshTable(name)
        return written

    def crowded(self, spark: SparkSession, most_runs: int, share: float = 0.25) -> bool:
        """Whether there are ``most_runs`` runs, or they hold more than ``share`` of the base's rows.

        Rows are counted from the files' own figures.
        """
        numbers = self.numbers(spark)
        if len(numbers) >= most_runs:
            return True
        return bool(numbers) and self.runs(spark).count() > share * self.base(spark).count()

    def compact(self, spark: SparkSession) -> DataFrame:
        """Fold the runs into a new base; the content stays the same."""
        numbers = self.numbers(spark)
        if not numbers:
            return self.content(spark)
        in_place = self.buckets is not None and self._laid_out(spark)
        overwrite_table(
            self._folded(spark, numbers) if in_place else self.content(spark),
            self.path, self.table, self.database,
            database_location=self.location, buckets=self.buckets, dealt=in_place,
        )
        self._clear_runs(spark)
        return self.content(spark)

    def _laid_out(self, spark: SparkSession) -> bool:
        """Whether the base's rows lie in the buckets that ``buckets`` gives them; those without a key may lie in any."""
        base = scan_table(spark, self.table, self.database)
        if BUCKET not in base.columns:
            return False
        keyed = quoted(self.buckets.column).isNotNull()
        astray = F.when(keyed, F.col(BUCKET) != self.buckets.of_key()).otherwise(F.col(BUCKET) >= self.buckets.number)
        return base.filter(astray).isEmpty()

    def _folded(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        """The content by bucket. Only the runs' rows are shuffled, and those of the base's files below ``LEAST_KEPT``."""
        names = [*map(quoted, self.base(spark).columns), BUCKET]
        unchanged, changed = self._current(spark, numbers)
        large = F.col(FILE_SIZE) >= LEAST_KEPT
        moved = self.buckets.assign(changed.select(*names[:-1])).select(*names)
        moved = moved.unionByName(unchanged.filter(~large).select(*names)).hint("rebalance", F.col(BUCKET))
        rows = unchanged.filter(large).select(*names).unionByName(moved)
        return rows.sortWithinPartitions(BUCKET, quoted(self.key))
