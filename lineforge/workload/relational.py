"""Dedupe, upsert, anti join, fetch windows, holdout and split."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineforge.operators.antijoin import not_in
from lineforge.operators.dedupe import dedupe_latest, dedupe_max_max
from lineforge.operators.increments import fetch_windows, select_windows
from lineforge.operators.sampling import holdout_head, holdout_parts, holdout_tail, is_test_row
from lineforge.operators.upsert import latest_lines, upsert
from lineforge.plans import silver, upkeep
from lineforge.plans.columns import ADDED_COLUMNS, BRONZE_COLUMNS, KEY, SOURCE_COLUMNS
from lineforge.session import run_dir
from lineforge.sources.files import write_parquet
from lineforge.sources.runs import RunTable
from lineforge.sources.tables import Buckets
from lineforge.workload.bronze import bronze, bronze_sql, bronze_table, by_bucket, dealt_width, read
from lineforge.workload.registry import query
from lineforge.workload.sql import BRONZE, SILVER, with_

LINE_KEY = ("l_orderkey", "l_linenumber")


@query(
    "dedupe_max_max",
    """with t as (select l_orderkey, l_linenumber, l_partkey, l_returnflag,
         ' ' || strftime(l_shipdate, '%Y%m%d') as "JOTSTP",
         cast(l_suppkey as varchar) || ' ' as "JOSEQN" from lineitem),
       m as (select l_orderkey, l_linenumber, max(trim("JOTSTP")) as a, max(trim("JOSEQN")) as b
         from t group by all)
       select t.* from t join m using (l_orderkey, l_linenumber)
       where trim("JOTSTP") = a and trim("JOSEQN") = b""",
)
def dedupe_max_max_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        *LINE_KEY,
        "l_partkey",
        "l_returnflag",
        F.concat(F.lit(" "), F.date_format("l_shipdate", "yyyyMMdd")).alias("JOTSTP"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit(" ")).alias("JOSEQN"),
    )
    return dedupe_max_max(lines, LINE_KEY)


@query(
    "dedupe_latest",
    """select * exclude (n) from (
         select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice,
           row_number() over (partition by l_orderkey, l_linenumber
             order by l_shipdate desc, l_partkey, l_suppkey, l_extendedprice) as n
         from lineitem) where n = 1""",
)
def dedupe_latest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        *LINE_KEY, "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    order = [F.col("l_shipdate").desc(), F.col("l_partkey"), F.col("l_suppkey")]
    return dedupe_latest(lines, LINE_KEY, [*order, F.col("l_extendedprice")])


SNAPSHOT_END = date(2000, 1, 1)
BATCH_START = date(1999, 1, 1)
FETCHED_AT = "2024-02-01T09:00:00"


def _batch_values() -> dict[str, str]:
    """What the batch says differently, as SQL both engines read."""
    return {
        "status": "'Cancelled'",
        "pendingItemQuantity": "'0'",
        "catOrderStatus": "'Closed'",
        "insertDateTime": f"'{FETCHED_AT}'",
    }


def upsert_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines entered before a date, and a batch of lines entered from an earlier date on."""
    lines = bronze_table(spark, sf_dir)
    snapshot = lines.filter(F.col("createdDateTime") < F.lit(f"{SNAPSHOT_END}"))
    later = lines.filter(F.col("createdDateTime") >= F.lit(f"{BATCH_START}"))
    return snapshot, _as_batch(later)


def _as_batch(later: DataFrame) -> DataFrame:
    return later.drop("changedDateTime").withColumns({name: F.expr(sql) for name, sql in _batch_values().items()})


_UPSERTED = ", ".join(
    f"case when s.polExternalID is not null then s.{c} else t.{c} end as {c}"
    for c in (*SOURCE_COLUMNS, "catOrderStatus")
)


_MERGED = f"""with lines as ({bronze_sql(extra="d")}),
snapshot as (select * exclude (d) from lines where d < date '{SNAPSHOT_END}'),
batch as (select * exclude (d) replace ({', '.join(f'{v} as {k}' for k, v in _batch_values().items())})
  from lines where d >= date '{BATCH_START}')
select {_UPSERTED},
  case when t.polExternalID is not null then t.insertDateTime else s.insertDateTime end
    as insertDateTime,
  case when t.polExternalID is not null and s.polExternalID is not null then s.insertDateTime
    else t.changedDateTime end as changedDateTime
from snapshot t full join batch s on t.polExternalID = s.polExternalID"""


@query("merge_upsert", _MERGED)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, batch = upsert_inputs(spark, sf_dir)
    return upsert(snapshot, batch)


def snapshot_and_batch(spark: SparkSession, sf_dir: str) -> tuple[RunTable, DataFrame]:
    """The snapshot as a table of base and runs, with earlier values of half the batch in a first run."""
    mark = uuid.uuid4().hex[:12]
    location = run_dir(spark, "merge_by_runs")
    table = RunTable("parts", f"merge_{mark}", f"{location}/parts", KEY, location, Buckets(8, KEY))
    width = dealt_width(spark, sf_dir)

    def by_key(orders: DataFrame) -> DataFrame:
        return orders.repartition(width, "k").sortWithinPartitions("k")

    # Orders are dealt out, not their lines of 48 columns.
    snapshot = bronze(spark, sf_dir, dealt=by_bucket(table.buckets, width), where=f"d < date '{SNAPSHOT_END}'")
    table.create(snapshot, dealt=True)
    later = bronze(spark, sf_dir, dealt=by_key, where=f"d >= date '{BATCH_START}'")
    batch = write_parquet(_as_batch(later), f"{location}/batch")
    # A first run of lines the snapshot holds; the batch replaces them all again.
    held = batch.filter(F.col("createdDateTime") < F.lit(f"{SNAPSHOT_END}"))
    table.upsert(held.withColumn("status", F.lit("Superseded")), stored=True)
    return table, batch


@query("merge_by_runs", _MERGED, fixture=snapshot_and_batch)
def merge_by_runs(spark: SparkSession, given: tuple[RunTable, DataFrame]) -> DataFrame:
    """The upsert as a run beside the base, and the table's content after it."""
    table, batch = given
    table.upsert(batch, stored=True)
    return table.content(spark)


@query("merge_by_runs_compacted", _MERGED, fixture=snapshot_and_batch)
def merge_by_runs_compacted(spark: SparkSession, given: tuple[RunTable, DataFrame]) -> DataFrame:
    """The same after the runs were folded into a new base."""
    table, batch = given
    table.upsert(batch, stored=True)
    return table.compact(spark)


_KEPT_UP = f"""{SILVER.replace(BRONZE, "bronze as (" + _MERGED + ")")},
emergency as (select FACILITYNAME as center, cast(sum(PENDINGITEMQUANTITY) as bigint) as items,
  row_number() over (order by sum(PENDINGITEMQUANTITY) desc nulls last, FACILITYNAME) as place
  from silver where ORDERTYPE = 'EMERGENCY' and FACILITYNAME is not null group by 1)"""


@query(
    "gold_upkeep",
    with_(
        _KEPT_UP,
        """select 'dimcarrier' as table_name, CARRIERCODE as code, CARRIERNAME as name, count(*) as n
        from silver group by all
        union all select 'factEmergencyOrder', center, 'EMERGENCY', items from emergency where place <= 10""",
    ),
    fixture=snapshot_and_batch,
)
def gold_upkeep(spark: SparkSession, given: tuple[RunTable, DataFrame]) -> DataFrame:
    """Carrier pairs with their lines, and the report, from the state before a batch and its changes."""
    table, batch = given
    parts = silver.silver_parts(table.content(spark))
    folder = run_dir(spark, "gold_upkeep")
    carriers = write_parquet(upkeep.carrier_counts(parts), f"{folder}/carriers")
    centers = write_parquet(upkeep.center_sums(parts), f"{folder}/centers")
    changes = table.upsert(batch, stored=True, remember=upkeep.REMEMBERED)
    report = upkeep.fact_emergency_order(upkeep.centers_after(centers, changes))
    return (
        upkeep.carriers_after(carriers, changes)
        .select(F.lit("dimcarrier").alias("table_name"), F.col("CARRIERCODE").alias("code"), F.col("CARRIERNAME").alias("name"), F.col(upkeep.ROWS).alias("n"))
        .unionByName(
            report.select(F.lit("factEmergencyOrder").alias("table_name"), F.col("DISTRIBUTION_CENTER").alias("code"), F.col("ORDERTYPE").alias("name"), F.col("COUNT_OF_ITEMS").alias("n"))
        )
    )


_CHECKS = {
    **{("date_format", c): f"{c} like '%/%'" for c in ("SHIPPEDPGIDATE", "ORDERENTRYDATE", "ESTIMATEDSHIPDATE", "SHIPBYDATE")},
    **{("not_null", c): f"{c} is null" for c in ("ISPURGED", "POLEXTERNALID")},
    ("length", "PSO"): "length(PSO) = 8",
    **{("string_type", c): "false" for c in ("CUSTOMERREFERENCE", "CARRIERNAME", "CUSTOMERSTORAGELOCATION")},
}


@query(
    "dq_report_upkeep",
    with_(
        f"""{SILVER.replace(BRONZE, "bronze as (" + _MERGED + ")")}, r as ("""
        + " union all ".join(
            f"select '{kind}' as check_name, '{column}' as column_name, count(*) filter (where {test}) as failures from silver"
            for (kind, column), test in _CHECKS.items()
        )
        + """ union all select 'unique', 'POLEXTERNALID', count(*) from (select POLEXTERNALID from silver
        where POLEXTERNALID is not null group by 1 having count(*) > 1))""",
        "select *, failures = 0 as passed from r",
    ),
    fixture=snapshot_and_batch,
)
def dq_report_upkeep(spark: SparkSession, given: tuple[RunTable, DataFrame]) -> DataFrame:
    """The check report after a batch, from the counts before it and its changes."""
    table, batch = given
    parts = silver.silver_parts(table.content(spark))
    folder = run_dir(spark, "dq_upkeep")
    counts = write_parquet(upkeep.check_counts(parts), f"{folder}/counts")
    repeated = write_parquet(upkeep.repeated_keys(parts), f"{folder}/repeated")
    changes = table.upsert(batch, stored=True, remember=upkeep.CHECKED)
    now = silver.silver_parts(table.content(spark))
    return upkeep.check_report(
        upkeep.check_counts_after(counts, changes), upkeep.repeated_keys_after(repeated, now, changes)
    )


assert set(BRONZE_COLUMNS) == {*SOURCE_COLUMNS, *ADDED_COLUMNS}


LATEST_COLUMNS = ("polExternalID", "catOrderStatus", "insertDateTime", "modifiedDateTime")


@query(
    "merge_latest",
    f"""with lines as ({bronze_sql(*LATEST_COLUMNS, extra="o_custkey")})
    select * exclude (n) from (select cast(o_custkey as varchar) as "polExternalID",
      polExternalID as "line", catOrderStatus, insertDateTime, modifiedDateTime,
      row_number() over (partition by o_custkey order by insertDateTime desc nulls last,
        case when catOrderStatus = 'Closed' then 0 else 1 end,
        modifiedDateTime desc nulls last, polExternalID) as n from lines) where n = 1""",
)
def merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch rule for repeated keys, with the customer standing in for the key."""
    lines = bronze(spark, sf_dir, *LATEST_COLUMNS, extra="o_custkey")
    keyed = lines.select(
        F.col("o_custkey").cast("string").alias("polExternalID"),
        F.col("polExternalID").alias("line"),
        "catOrderStatus",
        "insertDateTime",
        "modifiedDateTime",
    )
    return latest_lines(keyed, tiebreak=[F.col("line")])


@query(
    "not_in_anti",
    """select o_orderkey, o_custkey, o_orderstatus from orders
       where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""",
)
def not_in_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    returned = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return not_in(orders, returned.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(
    "fetch_windows",
    """with anchor as (select cast(max(o_orderdate) as date) as t from orders),
    days as (select cast(unnest(generate_series(t - 2, t, interval 1 day)) as date) as d
      from anchor),
    windows as (select s as order_status, d as from_date, d + 1 as to_date
      from days, (values ('Open'), ('Closed')) as v(s)),
    counted as (select case when o_orderstatus = 'F' then 'Closed' else 'Open' end as s,
      cast(o_orderdate as date) as d, count(*) as n from orders group by all)
    select order_status, from_date, to_date, coalesce(n, 0) as n_lines
    from windows left join counted on s = order_status and d = from_date""",
)
def fetch_windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows ending on the last order date, with the lines each would fetch."""
    orders = read(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("Open").alias("order_status"),
        F.col("o_orderdate").cast("date").alias("from_date"),
    )
    windows = fetch_windows(orders.agg(F.max("from_date").alias("as_of")))
    counted = orders.groupBy("order_status", "from_date").agg(F.count("*").alias("n"))
    return windows.join(counted, ["order_status", "from_date"], "left").select(
        "order_status", "from_date", "to_date", F.coalesce("n", F.lit(0)).alias("n_lines")
    )


@query(
    "window_select",
    """select *, cast(ts as date) as from_date from events
       where ts >= timestamp '2024-01-13' and ts < timestamp '2024-01-16'""",
)
def window_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return select_windows(events, "ts", date(2024, 1, 15))


HOLDOUT_ORDER = ("o_orderdate", "o_orderkey")
_HELD = """numbered as (select o_orderkey, o_custkey, o_orderdate,
  row_number() over (order by o_orderdate desc, o_orderkey desc) as n from orders)"""


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")


@query("holdout_tail", with_(_HELD, "select * exclude (n) from numbered where n <= 10000"))
def holdout_tail_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout_tail(_ordered(spark, sf_dir), HOLDOUT_ORDER)


@query("holdout_head", with_(_HELD, "select * exclude (n) from numbered where n > 10000"))
def holdout_head_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout_head(_ordered(spark, sf_dir), HOLDOUT_ORDER)


@query(
    "holdout_unique",
    """select event_id, ts, row_number() over (order by ts desc, event_id desc) <= 5000 as held_out
       from events""",
)
def holdout_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order whose first column has about as many values as there are rows."""
    events = read(spark, sf_dir, "events").select("event_id", "ts")
    tail, head = holdout_parts(events, ("ts", "event_id"), 5000)
    return tail.withColumn("held_out", F.lit(True)).unionByName(head.withColumn("held_out", F.lit(False)))


@query(
    "holdout_text",
    """select cast(o_orderkey as varchar) as order_key, o_custkey,
       row_number() over (order by cast(o_orderkey as varchar) desc) <= 5000 as held_out from orders""",
)
def holdout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order by a text that is unique per row."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("order_key"), "o_custkey")
    tail, head = holdout_parts(orders, ("order_key",), 5000)
    return tail.withColumn("held_out", F.lit(True)).unionByName(head.withColumn("held_out", F.lit(False)))


@query(
    "split_train_test",
    """select o_orderkey, cast('0x' || substr(md5('42:' || cast(o_orderkey as varchar)), 1, 8)
       as bigint) % 100 < 33 as is_test from orders""",
)
def split_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", is_test_row("o_orderkey").alias("is_test"))
