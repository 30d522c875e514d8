"""Order lines with dirty text and nulls, derived from the given tables.

The given tables are clean, so the bronze columns are computed from every order by
arithmetic on its key. The same rules are written for Spark and for the SQL check;
they differ only in how dates are written as text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineforge.plans.columns import BRONZE_COLUMNS
from lineforge.session import run_dir
from lineforge.sources.tables import BUCKET, Buckets

SPARES = (
    "reservePrimPSO",
    "facilityPSO",
    "shipId",
    "partNumber",
    "sourcedPartNumber",
    "trackingNumber",
    "invoiceNumber",
    "invoiceReferenceNumber",
    "huNumber",
    "crmBillNumber",
    "containerNumber",
    "airwayBillNumber",
    "orderlineName",
    "customerReference",
    "sourceCustomerCode",
    "customerStorageLocation",
    "keyCatCustomerCode",
    "profile",
)


@dataclass(frozen=True)
class Dialect:
    iso: str
    month_first: str
    plus_days: str


SPARK = Dialect(
    iso="date_format({0}, 'yyyy-MM-dd')",
    month_first="date_format({0}, 'MM/dd/yyyy')",
    plus_days="date_add({0}, cast({1} as int))",
)
DUCK = Dialect(
    iso="strftime({0}, '%Y-%m-%d')",
    month_first="strftime({0}, '%m/%d/%Y')",
    plus_days="({0} + cast({1} as integer))",
)


def rules(dialect: Dialect) -> dict[str, str]:
    """Expression of each bronze column over order key ``k`` and order date ``d``."""

    def text(e: str) -> str:
        return f"cast({e} as string)"

    def plus(e: str) -> str:
        return dialect.plus_days.format("d", e)

    def mixed(e: str, m: str) -> str:
        first, iso = dialect.month_first.format(e), dialect.iso.format(e)
        return f"case when {m} = 0 then {first} else ' ' || {iso} || ' ' end"

    def moment(days: str, time: str) -> str:
        return f"{dialect.iso.format(plus(days))} || 'T{time}'"

    made = {
        "polExternalID": text("k"),
        "orderType": "case substr(o_orderpriority, 1, 1) when '1' then 'EMERGENCY' "
        "when '2' then 'CPRO ' when '3' then ' STOCK' when '4' then 'FDO' else 'WARRANTY' end",
        "transportMode": "case when k % 11 = 0 then null when k % 3 = 0 then 'AIR' "
        "else ' TRUCK ' end",
        "orderEntryDate": mixed("d", "k % 4"),
        "shippedPGIDate": f"case when k % 13 = 0 then null else {mixed(plus('k % 21 - 1'), 'k % 8')} end",
        "estimatedShipDate": f"case when k % 17 = 0 then null else {mixed(plus('k % 30'), 'k % 6')} end",
        "shipByDate": mixed(plus("45"), "k % 9"),
        "orderedQuantity": f"' ' || {text('1 + k % 50')}",
        "pendingItemQuantity": f"case when k % 19 = 0 then null else {text('k % 7')} end",
        "sourcedItemQuantity": f"{text('k % 12')} || ' '",
        "releaseItemQuantity": text("k % 5"),
        "materialRequestQuantity": "case k % 29 when 0 then 'n/a' when 1 then '.5' when 2 then '-.9' "
        f"when 3 then chr(9) || '1.5' when 4 then '7.' else {text('k % 40')} end",
        "invoicedItemQuantity": f"case when k % 31 = 0 then '' else {text('k % 9')} end",
        "customerSuppliedItemNumber": f"case when k % 2 = 0 then null else {text('k % 100')} end",
        "pso": f"case when k % 5 = 0 then {text('10000000 + k')} else {text('100000000 + k')} end",
        "isTransferOrder": "case when k % 6 = 0 then 'true' else ' false' end",
        "isTrackingActive": "case when k % 7 = 0 then 'true' else 'false ' end",
        "isPurged": "case when k % 10 = 0 then null when k % 2 = 0 then 'true' else 'false' end",
        "status": "case when o_orderstatus = 'F' then 'Shipped' when o_orderstatus = 'O' "
        "then 'Sourced ' when k % 2 = 0 then 'Null' else null end",
        "facilityName": "case when k % 23 = 0 then null else n_name end",
        "carrierCode": text("k % 6"),
        "carrierName": f"'CARRIER ' || {text('k % 6')} || ' '",
        "customerCode": text("o_custkey"),
        "createdDateTime": moment("0", "00:00:00"),
        "modifiedDateTime": moment("k % 30", "10:00:00"),
        "lastActivityDateTime": moment("k % 40", "12:30:00"),
        "relatedCustomer": "cast(null as string)",
        "catOrderStatus": "case when k % 10 = 5 then null when o_orderstatus = 'F' then 'Closed' "
        "else 'Open' end",
        "insertDateTime": "case when k % 5 < 2 then null else "
        f"'2024-01-0' || {text('1 + k % 9')} || 'T01:02:03' end",
        "changedDateTime": "cast(null as string)",
    }
    made |= {name: f"' ' || {text('k')}" for name in SPARES}
    return made


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bronze(
    spark: SparkSession,
    sf_dir: str,
    *columns: str,
    extra: str = "",
    dealt: bool | Callable[[DataFrame], DataFrame] = False,
    where: str = "true",
) -> DataFrame:
    """Bronze lines of all orders; the customer is joined only for ``facilityName``.

    With ``dealt`` orders are dealt out evenly by their key before the columns are made, so
    that a few narrow columns are shuffled and not the many wide ones; a function deals them
    out in its own way, and columns it adds are kept. ``where`` chooses orders by key ``k`` and
    date ``d``.
    """
    wanted = columns or BRONZE_COLUMNS
    made = rules(SPARK)
    orders = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as k",
        "cast(o_orderdate as date) as d",
        "o_orderpriority",
        "o_orderstatus",
        "o_custkey",
    ).where(where)
    if "facilityName" in wanted:
        customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        orders = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
        orders = orders.join(nation, orders.c_nationkey == nation.n_nationkey, "left")
    more = [extra] if extra else []
    if callable(dealt):
        given = orders.columns
        orders = dealt(orders)
        more += [c for c in orders.columns if c not in given]
    elif dealt:
        orders = orders.repartition("k")
    return orders.selectExpr(*(f"{made[c]} as {c}" for c in wanted), *more)


LINES_DEALT = 100_000  # orders that a task makes lines of


def dealt_width(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that orders are dealt out to."""
    width = math.ceil(read(spark, sf_dir, "orders").count() / LINES_DEALT)
    return max(width, spark.sparkContext.defaultParallelism)


def by_bucket(layout: Buckets, width: int) -> Callable[[DataFrame], DataFrame]:
    """Deals orders out by the bucket of their lines, for ``bronze``."""

    def deal(orders: DataFrame) -> DataFrame:
        keyed = layout.assign(orders.withColumn(layout.column, F.expr(rules(SPARK)[layout.column])))
        pieces = math.ceil(width / layout.number)
        dealt = keyed.drop(layout.column).repartition(width, BUCKET, F.pmod("k", F.lit(pieces)))
        # Within a task in order of the buckets, so that the wide lines need not be sorted to be written.
        return dealt.sortWithinPartitions(BUCKET, "k")

    return deal


_written: dict[tuple[str, str], str] = {}


def bronze_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of all lines as a written table, as the models find them.

    Written once per application and set of given tables, in evenly filled files.
    """
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _written:
        path = run_dir(spark, "bronze")
        bronze(spark, sf_dir, dealt=True).write.parquet(path)
        _written[made] = path
    return spark.read.parquet(_written[made])


def bronze_sql(*columns: str, extra: str = "") -> str:
    """The same lines as SQL text."""
    wanted = columns or BRONZE_COLUMNS
    made = rules(DUCK)
    listed = ",\n  ".join([f"{made[c]} as {c}" for c in wanted] + ([extra] if extra else []))
    return f"""select
  {listed}
from (
  select o_orderkey as k, cast(o_orderdate as date) as d, o_orderpriority, o_orderstatus,
         o_custkey, n_name
  from orders
  left join customer on o_custkey = c_custkey
  left join nation on c_nationkey = n_nationkey
) as lines"""
