"""Silver and gold models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineforge.plans import gold, silver
from lineforge.session import run_dir
from lineforge.sources.seeds import read_seed, write_status_seed
from lineforge.workload.bronze import bronze_table
from lineforge.workload.registry import query
from lineforge.workload.sql import FACT, SILVER, STATUS, with_


_seed_paths: dict[str, str] = {}


def seed_of(spark: SparkSession) -> DataFrame:
    """The status lookup, written once per application."""
    application = spark.sparkContext.applicationId
    if application not in _seed_paths:
        _seed_paths[application] = write_status_seed(spark, run_dir(spark, "statuses"))
    return read_seed(spark, _seed_paths[application])


def silver_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.silver_parts(bronze_table(spark, sf_dir))


@query("silver_parts", with_(SILVER, "select * from silver"))
def silver_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_of(spark, sf_dir)


@query(
    "silver_status",
    with_(
        f"{SILVER}, {STATUS}, counted as (select STATUS as status, count(*) as n from silver group by 1)",
        """select s.sequence, s.status, coalesce(c.n, 0) as n_lines
        from status s left join counted c on s.status = c.status""",
    ),
)
def silver_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned lookup with the silver lines of each status."""
    status = silver.silver_status(seed_of(spark))
    lines = silver_of(spark, sf_dir).groupBy(F.col("STATUS").alias("status"))
    return status.join(lines.agg(F.count("*").alias("n")), "status", "left").select(
        "sequence", "status", F.coalesce("n", F.lit(0)).alias("n_lines")
    )


@query(
    "gold_dimcarrier",
    with_(SILVER, 'select distinct CARRIERCODE as "CARRIERCODE", CARRIERNAME as "CARRIERNAME" from silver'),
)
def gold_dimcarrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_carrier(silver_of(spark, sf_dir))


@query(
    "gold_dimstatus",
    with_(
        f"{FACT}, counted as (select status_code, sum(pendingitemquantity) as n from fact group by 1)",
        """select s.sequence, s.status, cast(c.n as bigint) as pending_items
        from status s left join counted c on s.sequence = c.status_code""",
    ),
)
def gold_dimstatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status dimension with the pending items of the facts that point to it."""
    status = silver.silver_status(seed_of(spark))
    parts = silver_of(spark, sf_dir)
    facts = gold.fact_parts(parts, status).groupBy(F.col("status_code").alias("sequence"))
    pending = facts.agg(F.sum("pendingitemquantity").alias("pending_items"))
    return gold.dim_status(status).join(pending, "sequence", "left")


@query("gold_factparts", with_(FACT, "select * from fact"))
def gold_factparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.fact_parts(silver_of(spark, sf_dir), silver.silver_status(seed_of(spark)))


@query(
    "gold_emergency",
    with_(
        f"""{SILVER},
        emergency as (select FACILITYNAME as center, PENDINGITEMQUANTITY as pending from silver
          where ORDERTYPE = 'EMERGENCY' and FACILITYNAME is not null),
        sums as (select center, sum(pending) as items from emergency group by center),
        placed as (select *, row_number() over (order by items desc nulls last, center) as place
          from sums)""",
        """select center as "DISTRIBUTION_CENTER", 'EMERGENCY' as "ORDERTYPE",
        cast(items as bigint) as "COUNT_OF_ITEMS" from placed where place <= 10""",
    ),
)
def gold_emergency(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = silver_of(spark, sf_dir)
    return gold.fact_emergency_order(parts)
