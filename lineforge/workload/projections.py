"""Schema operators, scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lineforge.functions.casts import strict_int, truncated_int
from lineforge.functions.categories import ORDER_TYPE_CODES, TRANSPORT_CODES, encode
from lineforge.functions.dates import days_between, iso_date, mixed_date_text
from lineforge.functions.defaults import legacy_default, legacy_pso
from lineforge.operators import columns as ops
from lineforge.operators.unions import union_pages
from lineforge.plans.delivery import after_watermark
from lineforge.plans.quality import drop_ship_after_arrival
from lineforge.workload.bronze import bronze, read
from lineforge.workload.registry import query
from lineforge.workload.sql import BRONZE, by_age, date_sql, int_sql, with_


@query(
    "clean_columns",
    """select l_orderkey as "l_order_key", l_quantity as "qtyeach", l_extendedprice as "price_net",
       l_returnflag as "a_b" from lineitem""",
)
def clean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    dirty = lines.select(
        F.col("l_orderkey").alias("l order.key"),
        F.col("l_quantity").alias("qty[each]\r"),
        F.col("l_extendedprice").alias("price (net)"),
        F.col("l_returnflag").alias("a. b"),
    )
    return ops.clean_columns(dirty)


@query(
    "add_md",
    """select o_orderkey, '2024-01-31 09:20:32' as "md_Date", 'orders' as "SourceSystem"
       from orders""",
)
def add_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    marked = ops.add_metadata(orders, "orders", as_of="2024-01-31 01:20:32")
    return marked.withColumn("md_Date", F.col("md_Date").cast("string"))


@query(
    "apply_schema",
    with_(
        BRONZE,
        f"""select polExternalID, {int_sql('orderedQuantity')} as "orderedQuantity",
        {int_sql('materialRequestQuantity')} as "materialRequestQuantity",
        cast(trim(carrierCode) as bigint) as "carrierCode",
        cast(trim(isTransferOrder) as boolean) as "isTransferOrder",
        try_cast(trim(orderType) as varchar) as "orderType" from bronze""",
    ),
)
def apply_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("orderedQuantity", T.IntegerType()),
            T.StructField("materialRequestQuantity", T.IntegerType()),
            T.StructField("carrierCode", T.LongType()),
            T.StructField("isTransferOrder", T.BooleanType()),
            T.StructField("orderType", T.StringType()),
        ]
    )
    return ops.apply_schema(bronze(spark, sf_dir, "polExternalID", *schema.names), schema)


@query(
    "to_integer",
    with_(
        BRONZE,
        f"""select polExternalID, {int_sql('materialRequestQuantity')} as "materialRequestQuantity",
        {int_sql('invoicedItemQuantity')} as "invoicedItemQuantity" from bronze""",
    ),
)
def to_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantities = ["materialRequestQuantity", "invoicedItemQuantity"]
    return ops.to_integer(bronze(spark, sf_dir, "polExternalID", *quantities), quantities)


@query(
    "to_timestamp",
    with_(
        BRONZE,
        """select polExternalID,
        cast(try_cast(createdDateTime as timestamp) as varchar) as "createdDateTime",
        cast(try_cast(insertDateTime as timestamp) as varchar) as "insertDateTime" from bronze""",
    ),
)
def to_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = ["createdDateTime", "insertDateTime"]
    typed = ops.to_timestamp(bronze(spark, sf_dir, "polExternalID", *moments), moments)
    return typed.select("polExternalID", *(F.col(m).cast("string").alias(m) for m in moments))


@query(
    "mdy_to_date",
    with_(
        BRONZE,
        """select polExternalID,
        cast(try_strptime(orderEntryDate, '%m/%d/%Y') as date) as "orderEntryDate",
        cast(try_strptime(shippedPGIDate, '%m/%d/%Y') as date) as "shippedPGIDate" from bronze""",
    ),
)
def mdy_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = ["orderEntryDate", "shippedPGIDate"]
    return ops.month_first_to_date(bronze(spark, sf_dir, "polExternalID", *dates), dates)


@query(
    "iso_to_date",
    with_(
        BRONZE,
        """select polExternalID, cast(try_cast(modifiedDateTime as timestamp) as date)
        as "modifiedDateTime" from bronze""",
    ),
)
def iso_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.iso_to_date(
        bronze(spark, sf_dir, "polExternalID", "modifiedDateTime"), ["modifiedDateTime"]
    )


@query(
    "nan_to_null",
    """select l_orderkey, l_linenumber, l_quantity,
       case when l_quantity > 45 then null else l_tax end as l_tax from lineitem""",
)
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.when(F.col("l_quantity") > 45, float("nan")).otherwise(F.col("l_tax")).alias("l_tax"),
    )
    return ops.nan_to_null(lines)


@query(
    "void_to_string",
    """select o_orderkey, cast(null as varchar) as "relatedCustomer", 'string' as "type_name",
       o_orderstatus = 'F' as voided, 'struct<voided:boolean>' as "state_type",
       'struct<code:string,legs:array<string>>' as "route_type" from orders""",
)
def void_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column without a type, a nested one, and one whose field is only called like it."""
    nothing = F.lit(None)
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        nothing.alias("relatedCustomer"),
        F.struct((F.col("o_orderstatus") == "F").alias("voided")).alias("state"),
        F.struct(nothing.alias("code"), F.array(nothing).alias("legs")).alias("route"),
    )
    typed = ops.void_to_string(orders)
    return typed.select(
        "o_orderkey",
        "relatedCustomer",
        F.typeof("relatedCustomer").alias("type_name"),
        "state.voided",
        F.typeof("state").alias("state_type"),
        F.typeof("route").alias("route_type"),
    )


@query(
    "stamp_provenance",
    """select o_orderkey, case when o_orderstatus = 'F' then 'Closed' else 'Open' end
       as "catOrderStatus", '2024-02-01T04:05:06' as "insertDateTime" from orders""",
)
def stamp_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    closed = F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("Open")
    stamped = ops.stamp_provenance(orders, closed, as_of="2024-01-31 20:05:06")
    return stamped.select("o_orderkey", "catOrderStatus", "insertDateTime")


@query(
    "cast_int",
    """select l_orderkey, l_linenumber, l_extendedprice,
       cast(trunc(cast(l_extendedprice as decimal(18,2))) as integer) as truncated,
       case l_linenumber when 1 then 0 when 2 then 0 when 3 then cast(l_quantity as integer)
         when 4 then cast(-l_quantity as integer) when 5 then null
         else cast(l_quantity as integer) end as odd,
       cast(l_quantity as integer) as strict from lineitem""",
)
def cast_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    price = F.concat(F.lit(" "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    quantity = F.col("l_quantity").cast("int").cast("string")
    line = F.col("l_linenumber")
    odd = (
        F.when(line == 1, ".5")
        .when(line == 2, "-.9")
        .when(line == 3, F.concat(F.lit("\t"), quantity, F.lit(".5\n")))
        .when(line == 4, F.concat(F.lit("-"), quantity, F.lit(".")))
        .when(line == 5, F.concat(quantity, F.lit(",0")))
        .otherwise(F.concat(F.lit(" +"), quantity))
    )
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        truncated_int(price).alias("truncated"),
        truncated_int(odd).alias("odd"),
        strict_int(quantity).alias("strict"),
    )


@query(
    "trim_all",
    with_(
        BRONZE,
        """select trim(polExternalID) as "polExternalID", trim(orderType) as "orderType",
        trim(transportMode) as "transportMode", trim(carrierName) as "carrierName",
        trim(shipId) as "shipId" from bronze""",
    ),
)
def trim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.trim_all(
        bronze(spark, sf_dir, "polExternalID", "orderType", "transportMode", "carrierName", "shipId")
    )


DATE_COLUMNS = ("shippedPGIDate", "orderEntryDate", "estimatedShipDate", "shipByDate")


@query(
    "mixed_date",
    with_(
        BRONZE,
        "select polExternalID, "
        + ", ".join(f'{date_sql(c)} as "{c}"' for c in DATE_COLUMNS)
        + " from bronze",
    ),
)
def mixed_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bronze(spark, sf_dir, "polExternalID", *DATE_COLUMNS)
    return lines.withColumns({c: mixed_date_text(F.col(c)) for c in DATE_COLUMNS})


@query("pso_pad", with_(BRONZE, by_age("PSO", "pso")))
def pso_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bronze(spark, sf_dir, "polExternalID", "pso", "insertDateTime")
    return lines.select(
        "polExternalID", legacy_pso(F.col("pso"), F.col("insertDateTime")).alias("pso")
    )


@query("default_purged", with_(BRONZE, by_age("ISPURGED", "isPurged")))
def default_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bronze(spark, sf_dir, "polExternalID", "isPurged", "insertDateTime")
    filled = legacy_default(F.col("isPurged"), F.col("insertDateTime"), "false")
    return lines.select("polExternalID", filled.alias("isPurged"))


@query("default_status", with_(BRONZE, by_age("CATORDERSTATUS", "catOrderStatus")))
def default_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bronze(spark, sf_dir, "polExternalID", "catOrderStatus", "insertDateTime")
    filled = legacy_default(F.col("catOrderStatus"), F.col("insertDateTime"), "Open")
    return lines.select("polExternalID", filled.alias("catOrderStatus"))


@query(
    "day_diffs",
    with_(
        f"""{BRONZE}, parsed as (select polExternalID,
        try_cast({date_sql('orderEntryDate')} as date) as e,
        try_cast({date_sql('shippedPGIDate')} as date) as s,
        try_cast({date_sql('estimatedShipDate')} as date) as a from bronze)""",
        """select polExternalID, cast(s - e as integer) as "DaysToShip",
        cast(a - e as integer) as "DaysToDelivery" from parsed""",
    ),
)
def day_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("orderEntryDate", "shippedPGIDate", "estimatedShipDate")
    lines = bronze(spark, sf_dir, "polExternalID", *names)
    entered, shipped, arrival = (iso_date(mixed_date_text(F.col(n))) for n in names)
    return lines.select(
        "polExternalID",
        days_between(shipped, entered).alias("DaysToShip"),
        days_between(arrival, entered).alias("DaysToDelivery"),
    )


@query(
    "encode_categories",
    with_(
        BRONZE,
        """select polExternalID,
        case trim(transportMode) when 'TRUCK' then 1 when 'AIR' then 2 end as "transportMode",
        case trim(orderType) when 'STOCK' then 1 when 'CPRO' then 2 when 'FDO' then 3
          when 'EMERGENCY' then 4 when 'WARRANTY' then 5 end as "orderType" from bronze""",
    ),
)
def encode_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bronze(spark, sf_dir, "polExternalID", "transportMode", "orderType")
    return lines.select(
        "polExternalID",
        encode(F.trim("transportMode"), TRANSPORT_CODES).alias("transportMode"),
        encode(F.trim("orderType"), ORDER_TYPE_CODES).alias("orderType"),
    )


@query(
    "filter_not_null",
    with_(
        BRONZE,
        """select polExternalID, transportMode, estimatedShipDate from bronze
        where transportMode is not null and estimatedShipDate is not null""",
    ),
)
def filter_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bronze(spark, sf_dir, "polExternalID", "transportMode", "estimatedShipDate")
    return lines.filter(F.col("transportMode").isNotNull() & F.col("estimatedShipDate").isNotNull())


@query(
    "filter_keep_unknown",
    with_(
        f"""{BRONZE}, parsed as (select polExternalID, {date_sql('shippedPGIDate')} as shipped,
        {date_sql('estimatedShipDate')} as arrival from bronze)""",
        """select polExternalID, shipped, arrival from parsed
        where shipped is null or arrival is null or shipped <= arrival""",
    ),
)
def filter_keep_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bronze(spark, sf_dir, "polExternalID", "shippedPGIDate", "estimatedShipDate").select(
        "polExternalID",
        mixed_date_text(F.col("shippedPGIDate")).alias("shipped"),
        mixed_date_text(F.col("estimatedShipDate")).alias("arrival"),
    )
    return drop_ship_after_arrival(lines, "shipped", "arrival")


@query(
    "after_watermark_row",
    """select l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') as shipped from lineitem
       where strftime(l_shipdate, '%Y-%m-%d') >
         (select max(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) from orders)""",
)
def after_watermark_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")
    )
    seen = read(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("seen_at")
    )
    return after_watermark(lines, seen, "shipped", "seen_at")


@query(
    "union_pages",
    with_(
        BRONZE,
        """select polExternalID, orderType, case when catOrderStatus = 'Closed' then null
        else carrierCode end as "carrierCode", coalesce(catOrderStatus, 'Open')
        as "catOrderStatus" from bronze""",
    ),
)
def union_pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and closed lines whose pages differ in column order, one lacking a column."""
    lines = bronze(spark, sf_dir, "polExternalID", "orderType", "carrierCode", "catOrderStatus")
    closed = F.coalesce(F.col("catOrderStatus") == "Closed", F.lit(False))
    opened = lines.filter(~closed).withColumn(
        "catOrderStatus", F.coalesce("catOrderStatus", F.lit("Open"))
    )
    return union_pages(
        [opened, lines.filter(closed).select("catOrderStatus", "polExternalID", "orderType")]
    )
