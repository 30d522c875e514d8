"""The daily job end to end."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lineforge.operators.unions import union_pages
from lineforge.plans import daily
from lineforge.plans.columns import ADDED_COLUMNS, SOURCE_COLUMNS
from lineforge.plans.quality import PARTS_CHECKS, STATUS_CHECKS
from lineforge.session import run_dir
from lineforge.sources.files import write_parquet
from lineforge.sources.pages import write_pages
from lineforge.sources.seeds import write_status_seed
from lineforge.workload.bronze import SPARK, bronze, bronze_sql, by_bucket, dealt_width, rules
from lineforge.workload.registry import query
from lineforge.workload.relational import BATCH_START, SNAPSHOT_END
from lineforge.workload.scans import page_of
from lineforge.workload.sql import BRONZE, FEATURES, WEIGHTS, with_

AS_OF = "2024-01-31 01:20:32"
FIRST_DAY = date(2024, 1, 29)
SNAPSHOT_BUCKETS = 16


def prepare_lake(spark: SparkSession, sf_dir: str) -> daily.Lake:
    """A bronze snapshot of earlier lines, and page files with later, overlapping ones.

    Orders are dealt out by bucket and by page before their lines' many columns are made.
    """
    base, mark = run_dir(spark, "daily"), uuid.uuid4().hex[:12]
    lake = daily.Lake(
        account="lake",
        pages=f"{base}/pages",
        seed=write_status_seed(spark, f"{base}/statuses"),
        uri=base + "/{account}/{zone}",
        bronze=f"bronze_{mark}",
        silver=f"silver_{mark}",
        gold=f"gold_{mark}",
        snapshot_buckets=SNAPSHOT_BUCKETS,
    )
    made, width = rules(SPARK), dealt_width(spark, sf_dir)

    def by_page(orders: DataFrame) -> DataFrame:
        placed = orders.withColumns(page_of(F.col("k"), F.expr(made["catOrderStatus"]), FIRST_DAY))
        return placed.repartition(width, "orderStatus", "fromDate", "page")

    dealt = by_bucket(lake.layout, width)
    earlier = bronze(spark, sf_dir, dealt=dealt, where=f"d < date '{SNAPSHOT_END}'")
    lake.store(earlier, "parts", lake.bronze, lake.layout, dealt=True)
    outer = ("orderStatus", "fromDate", "page")
    later = bronze(spark, sf_dir, *SOURCE_COLUMNS, dealt=by_page, where=f"d >= date '{BATCH_START}'")
    write_pages(later.select(*SOURCE_COLUMNS, *outer), lake.pages, "page")
    return lake


LOADED = "2024-01-31T09:20:32"  # the run's time, eight hours on
# Columns whose values are summed up, by table.
SUMMED = {
    "bronze.parts": (*SOURCE_COLUMNS, *ADDED_COLUMNS),
    "silver.parts": (
        "POLEXTERNALID", "PSO", "ISPURGED", "CATORDERSTATUS", "DEALERCODE", "ORDERENTRYDATE",
        "SHIPPEDPGIDATE", "SHIPBYDATE", "MATERIALREQUESTQUANTITY", "INSERTDATETIME", "CHANGEDDATETIME",
    ),
    "gold.dimcarrier": ("CARRIERCODE", "CARRIERNAME"),
    "gold.dimstatus": ("sequence", "status"),
    "gold.factparts": (
        "polexternalid", "status_code", "pendingitemquantity", "estimatedshipdate", "dealercode",
        "catorderstatus", "changeddatetime",
    ),
    "gold.factEmergencyOrder": ("DISTRIBUTION_CENTER", "ORDERTYPE", "COUNT_OF_ITEMS"),
    "checks": ("check_name", "column_name", "failures"),
    "gold.deliveryprediction": ("polExternalID", "transportMode", "DaysToShip", "Prediction_Datetime"),
}


def _sum_sql(table: str) -> str:
    values = ", ".join(f"coalesce(cast({c} as varchar), '~')" for c in SUMMED.get(table, ()))
    if not values:
        return "0"
    return f"coalesce(sum(cast('0x' || substr(md5(concat_ws('|', {values})), 1, 8) as bigint)), 0)"


def _daily_sql() -> str:
    source = ", ".join(SOURCE_COLUMNS)
    merged = f"""lines as ({bronze_sql()}),
bronze as (select {source},
  case when createdDateTime >= '{BATCH_START}' then coalesce(catOrderStatus, 'Open')
    else catOrderStatus end as catOrderStatus,
  case when createdDateTime >= '{SNAPSHOT_END}' then '{LOADED}' else insertDateTime end as insertDateTime,
  case when createdDateTime >= '{BATCH_START}' and createdDateTime < '{SNAPSHOT_END}' then '{LOADED}'
    end as changedDateTime from lines)"""
    emergency = """emergency as (select center as "DISTRIBUTION_CENTER", 'EMERGENCY' as "ORDERTYPE",
  cast(items as bigint) as "COUNT_OF_ITEMS" from (
    select FACILITYNAME as center, sum(PENDINGITEMQUANTITY) as items,
      row_number() over (order by sum(PENDINGITEMQUANTITY) desc nulls last, FACILITYNAME) as place
    from silver where ORDERTYPE = 'EMERGENCY' and FACILITYNAME is not null group by 1) where place <= 10)"""
    names = [(c.kind, c.column) for c in (*PARTS_CHECKS, *STATUS_CHECKS)]
    # Only lines that came without a purge flag since fail a check; the load is fresh.
    rows = [
        f"select '{kind}' as check_name, '{column}' as column_name, "
        + ("count(*) filter (where ISPURGED is null)" if column == "ISPURGED" else
           "count(*) filter (where length(PSO) = 8)" if column == "PSO" else "count(*) filter (where false)")
        + " as failures from silver"
        for kind, column in (*names, ("freshness", "insertDateTime"))
    ]
    checks = f"checks as ({' union all '.join(rows)})"
    scored = f"""scored as (select *, '{AS_OF}' as "Prediction_Datetime" from features)"""
    tables = {
        "raw.unreadable": "(select 1 where false)",
        "bronze.parts": "bronze",
        "bronze.statuses": "status",
        "silver.parts": "silver",
        "silver.status": "status",
        "gold.dimcarrier": "(select distinct CARRIERCODE, CARRIERNAME from silver)",
        "gold.dimstatus": "status",
        "gold.factparts": "fact",
        "gold.factEmergencyOrder": "emergency",
        "checks": "checks",
        "gold.deliveryprediction": "scored",
    }
    return with_(
        f"{FEATURES.replace(BRONZE, merged)}, {emergency}, {checks}, {scored}",
        " union all ".join(
            f"select '{name}' as table_name, count(*) as n_rows, cast({_sum_sql(name)} as bigint) as value_sum "
            f"from {rows}"
            for name, rows in tables.items()
        ),
    )


def value_sum(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """A sum over the rows of a hash of the columns' values."""
    if not columns:
        return F.lit(0).cast("bigint")
    values = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    digest = F.conv(F.substring(F.md5(values.cast("binary")), 1, 8), 16, 10)
    return F.coalesce(F.sum(digest.cast("bigint")), F.lit(0))


@query("daily_run_end_to_end", _daily_sql(), fixture=prepare_lake)
def daily_run_end_to_end(spark: SparkSession, lake: daily.Lake) -> DataFrame:
    """Rows of every table after one run of the daily job, and a sum over their values."""
    tables = daily.run(spark, lake, WEIGHTS, AS_OF, bootstrap=True)
    sums = union_pages(
        [
            df.agg(F.count("*").alias("n_rows"), value_sum(df, SUMMED.get(name, ())).alias("value_sum")).select(
                F.lit(name).alias("table_name"), "n_rows", "value_sum"
            )
            for name, df in tables.items()
        ]
    )
    # A row for each table, summed under the settings for wide rows.
    return write_parquet(sums, run_dir(spark, "sums"))
