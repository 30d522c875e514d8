"""The daily job: ingest, seed, build, test, score; every step leaves tables behind."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lineforge.operators.columns import LOCAL_OFFSET_HOURS, stamp_provenance, void_to_string
from lineforge.operators.increments import fetch_windows
from lineforge.operators.unions import union_pages
from lineforge.operators.upsert import latest_lines, repeated_keys, upsert
from lineforge.plans import delivery, gold, quality, silver, upkeep
from lineforge.plans.columns import BRONZE_COLUMNS, KEY, LINE_SCHEMA
from lineforge.session import constant_rows, run_dir, setting
from lineforge.sources.files import write_parquet
from lineforge.sources.pages import (
    DAMAGED,
    DAY_DIRECTORY,
    FAULT,
    HARMLESS,
    STATUS_DIRECTORY,
    bad_pages,
    chain_faults,
    cut_sound_pages,
    page_counts,
    page_lines,
    read_pages,
    with_whole_lines,
)
from lineforge.sources.runs import MOST_SENT, RunTable
from lineforge.sources.seeds import load_seed
from lineforge.sources.tables import (
    BUCKET,
    Buckets,
    buckets_in,
    overwrite_table,
    replace_buckets,
    scan_table,
    table_exists,
)
from lineforge.sources.zones import ZONE_URI, land_raw, stage_table, zone_path

# The bronze key as it came, kept beside silver and fact rows: trimmed, two keys may be one.
LINE_KEY = "line_key"
PAGES_READ = 64  # of some 100 kB each; by default Spark reads 4096 rows at once
CARRIER_COUNTS, CENTER_SUMS, BUILT_FROM = "carrier_counts", "center_sums", "built_from"
BRONZE_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in BRONZE_COLUMNS])
PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField(delivery.PREDICTION, T.FloatType()),
        T.StructField("polExternalID", T.StringType()),
        T.StructField("transportMode", T.StringType()),
        T.StructField("orderType", T.StringType()),
        T.StructField("orderedQuantity", T.IntegerType()),
        T.StructField("DaysToShip", T.IntegerType()),
        T.StructField(delivery.SCORED_AT, T.StringType()),
    ]
)


@dataclass(frozen=True)
class Lake:
    """Where the job reads and writes.

    The bronze snapshot is a base, laid out in ``snapshot_buckets`` buckets of its key, and
    runs of changed rows, see ``sources.runs``; so are silver lines and the fact table. A day
    writes one run to each. They are folded once there are ``most_runs`` runs or these hold a
    quarter of the base's rows. With ``most_runs`` 0 there are no runs: a day reads and
    writes the buckets that hold keys of its batch, and all that follows is built anew. A
    run of the job fails if more than ``bad_pages`` of the pages are damaged, and with
    ``whole_chains`` also if the pages' cursors don't link them to one chain for each status
    and day of the fetch windows.
    """

    account: str
    pages: str
    seed: str
    entity: str = "parts"
    uri: str = ZONE_URI
    bronze: str = "bronze"
    silver: str = "silver"
    gold: str = "gold"
    snapshot_buckets: int = 16
    bad_pages: float = 0.01
    whole_chains: bool = False
    most_runs: int = 30

    def path(self, database: str, table: str = "") -> str:
        return zone_path(self.account, "tables", database, table, self.uri)

    def store(
        self,
        df: DataFrame,
        table: str,
        database: str,
        buckets: Buckets | None = None,
        partition: str | None = None,
        dealt: bool = False,
    ) -> DataFrame:
        return overwrite_table(
            df,
            self.path(database, table),
            table,
            database,
            database_location=self.path(database),
            buckets=buckets,
            partition=partition,
            dealt=dealt,
        )

    @property
    def layout(self) -> Buckets:
        return Buckets(self.snapshot_buckets, KEY)

    def _keyed(self, table: str, database: str, key: str, buckets: Buckets | None = None) -> RunTable:
        return RunTable(table, database, self.path(database, table), key, self.path(database), buckets)

    @property
    def snapshot(self) -> RunTable:
        return self._keyed("parts", self.bronze, KEY, self.layout)

    @property
    def silver_lines(self) -> RunTable:
        return self._keyed("parts", self.silver, LINE_KEY)

    @property
    def fact_lines(self) -> RunTable:
        return self._keyed("factparts", self.gold, LINE_KEY)

    def bronze_parts(self, spark: SparkSession) -> DataFrame:
        return self.snapshot.content(spark)

    def silver_parts(self, spark: SparkSession) -> DataFrame:
        return self.silver_lines.content(spark).drop(LINE_KEY)

    def fact(self, spark: SparkSession) -> DataFrame:
        return self.fact_lines.content(spark).drop(LINE_KEY)


def run_day(as_of: str) -> date:
    return date.fromisoformat(as_of[:10])


class DamagedPages(ValueError):
    """Too many of a run's pages are damaged."""


def few_pages(spark: SparkSession):
    """Written pages are read ``PAGES_READ`` at a time within the block; each holds all its lines' texts."""
    return setting(spark, "spark.sql.parquet.columnarReaderBatchSize", str(PAGES_READ))


def fetch(spark: SparkSession, lake: Lake, as_of: str) -> DataFrame:
    """The pages of the fetch windows cut into lines and written, so that they are parsed once.

    Damaged pages alone, if there are any, pass the function that finds their whole lines: its
    Python workers take memory beside the executors' for as long as the job runs.
    """
    cut = write_parquet(cut_sound_pages(read_pages(spark, lake.pages, run_day(as_of))), run_dir(spark, "pages"))
    damaged = cut.filter(DAMAGED)
    if damaged.isEmpty():
        return cut
    with few_pages(spark):
        recovered = write_parquet(with_whole_lines(damaged), run_dir(spark, "damaged"))
    return cut.filter(~F.col(DAMAGED)).unionByName(recovered)


def unreadable(spark: SparkSession, lake: Lake, as_of: str, pages: DataFrame | None = None) -> DataFrame:
    """Damaged pages of the fetch windows, with how many whole lines they gave."""
    return bad_pages(pages if pages is not None else read_pages(spark, lake.pages, run_day(as_of)))


def require_sound_pages(pages: DataFrame, share: float) -> None:
    """Raise if more than ``share`` of the pages are damaged."""
    counted = page_counts(pages).first()
    if counted["n_bad"] > share * counted["n_pages"]:
        raise DamagedPages(f"{counted['n_bad']} of {counted['n_pages']} pages are damaged")


class MissingPages(ValueError):
    """The pages of a status and day don't make one chain."""


def incomplete(spark: SparkSession, lake: Lake, as_of: str, pages: DataFrame | None = None) -> DataFrame:
    """Faults of the chains that the fetch windows' pages make, see ``pages.chain_faults``."""
    pages = pages if pages is not None else read_pages(spark, lake.pages, run_day(as_of))
    anchor = spark.range(1).select(F.lit(run_day(as_of)).alias("as_of"))
    expected = fetch_windows(anchor).select(
        F.col("order_status").alias(STATUS_DIRECTORY), F.col("from_date").alias(DAY_DIRECTORY)
    )
    return chain_faults(pages, expected)


def require_whole_chains(faults: DataFrame) -> None:
    """Raise if there are any faults but pages that came twice."""
    first = faults.filter(F.col(FAULT) != HARMLESS).orderBy(*faults.columns).first()
    if first is not None:
        raise MissingPages(", ".join(f"{name} {value!s}" for name, value in first.asDict().items()))


def _batch(spark: SparkSession, lake: Lake, as_of: str, pages: DataFrame | None) -> tuple[DataFrame, bool]:
    """The day's lines by way of raw and staging, one row per key, with the snapshot's columns.

    Also whether they are hardly more than a scan of staging, few keys being there twice.
    """
    day = run_day(as_of)
    pages = fetch(spark, lake, as_of) if pages is None else pages
    require_sound_pages(pages, lake.bad_pages)
    if lake.whole_chains:
        require_whole_chains(incomplete(spark, lake, as_of, pages))
    stamped = stamp_provenance(page_lines(pages, LINE_SCHEMA), F.col(STATUS_DIRECTORY), as_of)
    fetched = void_to_string(stamped.drop(STATUS_DIRECTORY, DAY_DIRECTORY))
    with few_pages(spark):
        land_raw(fetched, lake.account, lake.entity, day, lake.uri)
    staged = stage_table(
        spark, lake.account, lake.entity, day, "parts_tmp", lake.bronze, lake.uri
    )
    repeated = write_parquet(repeated_keys(staged), run_dir(spark, "repeated"))
    few = repeated.count() <= MOST_SENT
    latest = latest_lines(staged, repeated=repeated if few else None)
    return latest.withColumn("changedDateTime", F.lit(None).cast("string")).select(*BRONZE_COLUMNS), few


def ingest(spark: SparkSession, lake: Lake, as_of: str, pages: DataFrame | None = None) -> DataFrame | None:
    """Pages of the fetch windows to raw, to staging, to the bronze snapshot.

    Raw and staging keep fields the line schema does not name; the snapshot has its 48
    columns. Returns the changed rows with what they were before (``runs.BEFORE``), or null
    if the snapshot is new or has no runs.
    """
    layout, (batch, few) = lake.layout, _batch(spark, lake, as_of, pages)
    if lake.most_runs:
        if lake.snapshot.exists(spark):
            return lake.snapshot.upsert(batch, remember=upkeep.REMEMBERED, checked=True, stored=few)
        lake.snapshot.create(batch)
        return None
    batch = lake.store(layout.assign(batch), "parts_batch", lake.bronze)
    if not table_exists(spark, "parts", lake.bronze):
        lake.store(batch, "parts", lake.bronze, layout)
        return None
    touched = buckets_in(batch)
    snapshot = scan_table(spark, "parts", lake.bronze).filter(F.col(BUCKET).isin(*touched))
    replace_buckets(upsert(snapshot, batch, checked=True), "parts", lake.bronze, touched)
    return None


def seed(spark: SparkSession, lake: Lake) -> DataFrame:
    return load_seed(
        spark,
        lake.seed,
        lake.path(lake.bronze, "statuses"),
        "statuses",
        lake.bronze,
        database_location=lake.path(lake.bronze),
    )


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _silver_with_key(bronze: DataFrame) -> DataFrame:
    return bronze.select(*map(silver.silver_column, BRONZE_COLUMNS), F.col(KEY).alias(LINE_KEY))


def _fact_with_key(parts: DataFrame, status: DataFrame) -> DataFrame:
    return gold.fact_parts(parts, status, keep=(LINE_KEY,))


def build(spark: SparkSession, lake: Lake, changes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Silver tables, then the gold tables from what was written, not recomputed.

    With ``changes``, the day's changed bronze rows, what was built before is kept up from
    these alone; otherwise, or if the status lookup changed, all is built from bronze.
    """
    new_status = silver.silver_status(scan_table(spark, "statuses", lake.bronze))
    had = table_exists(spark, "status", lake.silver)
    same = had and _same_rows(scan_table(spark, "status", lake.silver), new_status)
    status = lake.store(new_status, "status", lake.silver)
    if changes is not None and same:
        lines = write_parquet(_silver_with_key(changes), run_dir(spark, "silver"))
        lake.silver_lines.append_run(lines)
        lake.fact_lines.append_run(_fact_with_key(lines, status))
        carriers = upkeep.carriers_after(scan_table(spark, CARRIER_COUNTS, lake.gold), changes)
        centers = upkeep.centers_after(scan_table(spark, CENTER_SUMS, lake.gold), changes)
    else:
        lines = lake.silver_lines.create(_silver_with_key(lake.bronze_parts(spark)))
        lake.fact_lines.create(_fact_with_key(lines, status))
        carriers, centers = upkeep.carrier_counts(lines), upkeep.center_sums(lines)
    carriers = lake.store(carriers, CARRIER_COUNTS, lake.gold)
    centers = lake.store(centers, CENTER_SUMS, lake.gold)
    return {
        "silver.parts": lake.silver_parts(spark),
        "silver.status": status,
        "gold.dimcarrier": lake.store(upkeep.dim_carrier(carriers), "dimcarrier", lake.gold),
        "gold.dimstatus": lake.store(gold.dim_status(status), "dimstatus", lake.gold),
        "gold.factparts": lake.fact(spark),
        "gold.factEmergencyOrder": lake.store(
            upkeep.fact_emergency_order(centers), "factEmergencyOrder", lake.gold
        ),
    }


def built_from(spark: SparkSession, lake: Lake) -> str:
    """The version of the snapshot that silver and gold were last built from."""
    if not table_exists(spark, BUILT_FROM, lake.gold):
        return ""
    return scan_table(spark, BUILT_FROM, lake.gold).first()["version"]


def fold_runs(spark: SparkSession, lake: Lake) -> None:
    """Compact the tables whose runs have become many or large.

    Frames over them that were made before can't be read afterwards, so a day begins with it.
    """
    for table in (lake.snapshot, lake.silver_lines, lake.fact_lines):
        if table.exists(spark) and table.crowded(spark, max(1, lake.most_runs)):
            table.compact(spark)


def check(spark: SparkSession, lake: Lake, as_of: str) -> DataFrame:
    """The check report over the silver tables as they are, and the freshness of bronze."""
    loaded = quality.freshness(
        lake.bronze_parts(spark), "insertDateTime", as_of, LOCAL_OFFSET_HOURS
    )
    fresh = loaded.select(
        F.lit("freshness").alias("check_name"),
        F.lit("insertDateTime").alias("column_name"),
        F.when(F.col("state") == "pass", 0).otherwise(1).cast("bigint").alias("failures"),
        (F.col("state") != "error").alias("passed"),
    )
    return union_pages(
        [
            quality.report(lake.silver_parts(spark), quality.PARTS_CHECKS),
            quality.report(scan_table(spark, "status", lake.silver), quality.STATUS_CHECKS),
            fresh,
        ]
    )


def score(
    spark: SparkSession,
    lake: Lake,
    model: PipelineModel | Mapping[str, float],
    as_of: str,
    bootstrap: bool,
) -> DataFrame:
    table = "deliveryprediction"
    path = lake.path(lake.gold, table)
    if not table_exists(spark, table, lake.gold):
        nulls = (F.lit(None).cast(f.dataType).alias(f.name) for f in PREDICTION_SCHEMA)
        nothing = delivery.with_day(spark.range(0).select(*nulls))
        lake.store(nothing, table, lake.gold, partition=delivery.SCORED_DAY)
    scored = scan_table(spark, table, lake.gold)
    fact = lake.fact(spark)
    done = delivery.score_batch(fact, scored, model, path, table, lake.gold, as_of, bootstrap)
    return done.drop(delivery.SCORED_DAY)


def run(
    spark: SparkSession,
    lake: Lake,
    model: PipelineModel | Mapping[str, float],
    as_of: str,
    bootstrap: bool = False,
    tests_first: bool = False,
) -> dict[str, DataFrame]:
    """One day's run. ``tests_first`` checks the tables of the day before.

    Silver and gold are kept up from the day's changes if they were built from the snapshot
    as the day found it; after a run that broke off they are built anew.
    """
    pages = fetch(spark, lake, as_of)
    found = lake.snapshot.version(spark)
    current = found != "" and built_from(spark, lake) == found
    fold_runs(spark, lake)
    changes = ingest(spark, lake, as_of, pages)
    tables = {
        "raw.unreadable": unreadable(spark, lake, as_of, pages),
        "bronze.parts": lake.bronze_parts(spark),
        "bronze.statuses": seed(spark, lake),
    }
    ready = tests_first and table_exists(spark, "parts", lake.silver)
    first = check(spark, lake, as_of) if ready else None
    tables |= build(spark, lake, changes if current else None)
    tables["checks"] = first if first is not None else check(spark, lake, as_of)
    tables["gold.deliveryprediction"] = score(spark, lake, model, as_of, bootstrap)
    now = constant_rows(spark, [(lake.snapshot.version(spark),)], "version")
    lake.store(now, BUILT_FROM, lake.gold)
    return tables


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    return union_pages(
        [
            df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            for name, df in tables.items()
        ]
    )
