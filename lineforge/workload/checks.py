"""Quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineforge.functions.dates import iso_date, mixed_date_text
from lineforge.plans import quality
from lineforge.workload.bronze import bronze, read
from lineforge.workload.models import silver_of
from lineforge.workload.registry import query
from lineforge.workload.sql import BRONZE, SILVER, date_sql, with_


@query(
    "dq_date_format",
    with_(BRONZE, "select polExternalID, orderEntryDate from bronze where orderEntryDate like '%/%'"),
)
def dq_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bronze(spark, sf_dir, "polExternalID", "orderEntryDate")
    return quality.date_format(lines, "orderEntryDate")


@query("dq_length", with_(BRONZE, "select polExternalID, pso from bronze where length(pso) = 8"))
def dq_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.length(bronze(spark, sf_dir, "polExternalID", "pso"), "pso", 8)


@query(
    "dq_string_type",
    """with t as (select 'name' as column_name, count(*) filter (where typeof(o_orderstatus) = 'VARCHAR')
         as n from orders
       union all select 'price', count(*) filter (where typeof(o_totalprice) = 'VARCHAR') from orders)
       select column_name, n from t where n = 0""",
)
def dq_string_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column, which passes, and a number column, which fails."""
    orders = read(spark, sf_dir, "orders")
    name = quality.string_type(orders, "o_orderstatus").withColumn("column_name", F.lit("name"))
    price = quality.string_type(orders, "o_totalprice").withColumn("column_name", F.lit("price"))
    return name.unionByName(price).select("column_name", "n")


@query(
    "dq_not_null",
    with_(BRONZE, "select polExternalID, facilityName from bronze where facilityName is null"),
)
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_null(bronze(spark, sf_dir, "polExternalID", "facilityName"), "facilityName")


@query(
    "dq_unique",
    """select line_id, count(*) as n_records from
       (select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as line_id
        from lineitem) group by 1 having count(*) > 1""",
)
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id")
    )
    return quality.unique(lines, "line_id")


AS_OF = "2024-01-10 12:00:00"


@query(
    "dq_freshness",
    with_(
        f"""{BRONZE}, latest as (select max(try_cast(insertDateTime as timestamp)) as t from bronze),
        aged as (select t, (epoch(timestamp '{AS_OF}') - epoch(t) + 8 * 3600) / 3600.0 as h from latest)""",
        """select cast(t as varchar) as latest, cast(h as double) as age_hours,
        case when h <= 24 then 'pass' when h <= 48 then 'warn' else 'error' end as state from aged""",
    ),
)
def dq_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = quality.freshness(
        bronze(spark, sf_dir, "insertDateTime"), "insertDateTime", AS_OF, offset_hours=8
    )
    return aged.select(
        F.col("latest").cast("string").alias("latest"),
        F.col("age_hours").cast("double").alias("age_hours"),
        "state",
    )


@query(
    "dq_entry_after_ship",
    with_(
        f"""{BRONZE}, parsed as (select polExternalID,
        try_cast({date_sql('orderEntryDate')} as date) as entered,
        try_cast({date_sql('shippedPGIDate')} as date) as shipped from bronze)""",
        "select polExternalID, entered, shipped from parsed where entered > shipped",
    ),
)
def dq_entry_after_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bronze(spark, sf_dir, "polExternalID", "orderEntryDate", "shippedPGIDate").select(
        "polExternalID",
        iso_date(mixed_date_text(F.col("orderEntryDate"))).alias("entered"),
        iso_date(mixed_date_text(F.col("shippedPGIDate"))).alias("shipped"),
    )
    return quality.entry_after_ship(lines, "entered", "shipped")


def _report_sql() -> str:
    counts = {
        ("date_format", "SHIPPEDPGIDATE"): "count(*) filter (where SHIPPEDPGIDATE like '%/%')",
        ("date_format", "ORDERENTRYDATE"): "count(*) filter (where ORDERENTRYDATE like '%/%')",
        ("date_format", "ESTIMATEDSHIPDATE"): "count(*) filter (where ESTIMATEDSHIPDATE like '%/%')",
        ("date_format", "SHIPBYDATE"): "count(*) filter (where SHIPBYDATE like '%/%')",
        ("not_null", "ISPURGED"): "count(*) filter (where ISPURGED is null)",
        ("length", "PSO"): "count(*) filter (where length(PSO) = 8)",
        ("not_null", "POLEXTERNALID"): "count(*) filter (where POLEXTERNALID is null)",
        ("string_type", "CUSTOMERREFERENCE"): "count(*) filter (where typeof(CUSTOMERREFERENCE) <> 'VARCHAR')",
        ("string_type", "CARRIERNAME"): "case when any_value(typeof(CARRIERNAME)) = 'VARCHAR' then 0 else 1 end",
        ("string_type", "CUSTOMERSTORAGELOCATION"): "count(*) filter (where typeof(CUSTOMERSTORAGELOCATION) <> 'VARCHAR')",
    }
    rows = [
        f"select '{check}' as check_name, '{column}' as column_name, {n} as failures from broken"
        for (check, column), n in counts.items()
    ]
    rows.append(
        "select 'unique', 'POLEXTERNALID', count(*) from (select POLEXTERNALID from broken "
        "where POLEXTERNALID is not null group by 1 having count(*) > 1)"
    )
    broken = """broken as (select * replace (
        case when k % 5 = 0 then '1/2/2024' else SHIPPEDPGIDATE end as SHIPPEDPGIDATE,
        case when k % 6 = 0 then '1/2' else ORDERENTRYDATE end as ORDERENTRYDATE,
        case when k % 7 = 0 then '/' else ESTIMATEDSHIPDATE end as ESTIMATEDSHIPDATE,
        case when k % 8 = 0 then 'a/b' else SHIPBYDATE end as SHIPBYDATE,
        case when k % 9 = 0 then '12345678' else PSO end as PSO,
        case when k % 10 = 0 then null when k % 11 = 0 then cast(k // 33 as varchar)
          else POLEXTERNALID end as POLEXTERNALID,
        k as CARRIERNAME)
      from (select *, cast(POLEXTERNALID as bigint) as k from silver))"""
    return with_(
        f"{SILVER}, {broken}, r as ({' union all '.join(rows)})",
        "select check_name, column_name, cast(failures as bigint) as failures, "
        "failures = 0 as passed from r",
    )


@query("dq_report", _report_sql())
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over lines of which some break each check, with a number for a carrier's name."""
    k = F.col("POLEXTERNALID").cast("bigint")
    changes = {
        "SHIPPEDPGIDATE": F.when(k % 5 == 0, "1/2/2024"),
        "ORDERENTRYDATE": F.when(k % 6 == 0, "1/2"),
        "ESTIMATEDSHIPDATE": F.when(k % 7 == 0, "/"),
        "SHIPBYDATE": F.when(k % 8 == 0, "a/b"),
        "PSO": F.when(k % 9 == 0, "12345678"),
    }
    broken = {name: change.otherwise(F.col(name)) for name, change in changes.items()}
    repeated = F.floor(k / 33).cast("string")
    broken["POLEXTERNALID"] = (
        F.when(k % 10 == 0, None).when(k % 11 == 0, repeated).otherwise(F.col("POLEXTERNALID"))
    )
    broken["CARRIERNAME"] = k
    return quality.report(silver_of(spark, sf_dir).withColumns(broken))
