"""Sources and sinks."""

from __future__ import annotations

import math
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lineforge.operators.columns import flatten_structs, schema_from_dtypes
from lineforge.plans.columns import LINE_SCHEMA, SOURCE_COLUMNS
from lineforge.session import run_dir
from lineforge.sources.files import (
    append_parquet,
    read_delimited,
    read_parquet,
    read_records,
    write_delimited,
    write_parquet,
)
from lineforge.sources.pages import UNKNOWN, chain_faults, page_lines, read_pages, write_pages
from lineforge.sources.seeds import load_seed, write_status_seed
from lineforge.sources.tables import append_table, overwrite_table, scan_table
from lineforge.sources.zones import land_raw, read_raw, stage_table
from lineforge.workload.bronze import bronze, bronze_table, read
from lineforge.workload.registry import query
from lineforge.workload.sql import BRONZE, SEED, with_

PAGE_LINES = 500


def fresh_database(spark: SparkSession, purpose: str) -> tuple[str, str]:
    """Name and location of a database no other run uses."""
    return f"lineforge_{purpose}_{uuid.uuid4().hex[:12]}", run_dir(spark, purpose)


@query("scan_parquet", "select * from lineitem")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/lineitem.parquet")


@query("write_parquet", "select doc_id, text, lang, source, n_chars from documents")
def write_parquet_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_parquet(read(spark, sf_dir, "documents"), run_dir(spark, "write_parquet"))


@query("append_parquet", "select * from orders")
def append_parquet_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "append_parquet")
    orders = read(spark, sf_dir, "orders")
    finished = F.col("o_orderstatus") == "F"
    write_parquet(orders.filter(finished), path)
    return append_parquet(orders.filter(~finished), path)


@query(
    "read_csv",
    """select cast(c_custkey as varchar) as c_custkey, c_name,
       cast(c_nationkey as varchar) as c_nationkey,
       cast(cast(c_acctbal as decimal(18,2)) as varchar) as c_acctbal, c_mktsegment
       from customer""",
)
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "read_csv")
    customers = read(spark, sf_dir, "customer")
    exact = customers.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    exact.write.option("header", True).option("sep", "|").csv(path)
    return read_delimited(spark, path)


@query(
    "write_csv",
    "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part",
)
def write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "write_csv")
    parts = read(spark, sf_dir, "part")
    write_delimited(parts, path)
    return read_delimited(spark, path, schema=parts.schema)


_ODD_TEXTS = """select doc_id, case doc_id % 3 when 0 then text || chr(92) when 1 then '"' || text || '"|'
  else text || chr(10) || 'end' end as text, lang from documents"""


# Bytes of text that one file of a few takes: more than a task reads of it.
FILE_BYTES = 256 * 1024 * 1024


def odd_texts(spark: SparkSession, sf_dir: str, path: str, file_bytes: int | None = None) -> T.StructType:
    """Write texts with line breaks, separators, quotes and a backslash at the end; returns their schema.

    With ``file_bytes`` they go to as few files as hold about so many bytes of text each.
    """
    end = F.pmod("doc_id", F.lit(3))
    text = (
        F.when(end == 0, F.concat("text", F.lit("\\")))
        .when(end == 1, F.concat(F.lit('"'), F.col("text"), F.lit('"|')))
        .otherwise(F.concat("text", F.lit("\nend")))
    )
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang")
    most_files = None
    if file_bytes is not None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        most_files = max(1, math.ceil(size / file_bytes))
    write_delimited(docs, path, escape_quotes=True, most_files=most_files)
    return docs.schema


@query("csv_multi_line", _ODD_TEXTS)
def csv_multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such texts there and back, a task for each file."""
    path = run_dir(spark, "csv_multi_line")
    schema = odd_texts(spark, sf_dir, path)
    return read_delimited(spark, path, schema=schema, multi_line=True)


def large_files_of_odd_texts(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    """Such texts in one file, or in several once they are more than a task should write."""
    path = run_dir(spark, "csv_records")
    return path, odd_texts(spark, sf_dir, path, file_bytes=FILE_BYTES)


@query("csv_records", _ODD_TEXTS, fixture=large_files_of_odd_texts)
def csv_records(spark: SparkSession, written: tuple[str, T.StructType]) -> DataFrame:
    """Such texts from large files that many tasks read."""
    path, schema = written
    return read_records(spark, path, schema)


@query(
    "table_overwrite",
    "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
)
def table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, location = fresh_database(spark, "table_overwrite")
    customers = read(spark, sf_dir, "customer")
    path = f"{location}/customer"
    overwrite_table(
        customers.select("c_custkey", "c_name"), path, "customer", database,
        database_location=location,
    )
    return overwrite_table(customers, path, "customer", database)


@query("table_append", "select * from orders")
def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, location = fresh_database(spark, "table_append")
    orders = read(spark, sf_dir, "orders")
    shipped = F.col("o_orderstatus") == "F"
    path = f"{location}/orders"
    append_table(orders.filter(shipped), path, "orders", database, database_location=location)
    others = orders.filter(~shipped).select(*reversed(orders.columns))
    return append_table(others, path, "orders", database)


@query(
    "table_scan",
    """select c_mktsegment, count(*) as n_customers,
       sum(cast(c_acctbal as decimal(18,2))) as balance from customer group by c_mktsegment""",
)
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, location = fresh_database(spark, "table_scan")
    overwrite_table(
        read(spark, sf_dir, "customer"), f"{location}/customer", "customer", database,
        database_location=location,
    )
    customers = scan_table(spark, "customer", database)
    return customers.groupBy("c_mktsegment").agg(
        F.count("*").alias("n_customers"),
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("balance"),
    )


@query(
    "raw_landing",
    """select *, case o_orderstatus when 'F' then date '2024-01-01'
       when 'O' then date '2024-01-02' else date '2024-01-03' end as landing_date from orders""",
)
def raw_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = run_dir(spark, "raw_landing") + "/{account}/{zone}"
    orders = read(spark, sf_dir, "orders")

    def land(status: str, day: date) -> None:
        part = orders.filter(F.col("o_orderstatus") == status)
        land_raw(part, "lake", "orders", day, uri)

    land("F", date(2024, 1, 1))
    land("P", date(2024, 1, 2))
    land("O", date(2024, 1, 2))
    land("P", date(2024, 1, 3))
    return read_raw(spark, "lake", "orders", uri=uri)


@query("stage_table", "select * from events")
def stage_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = run_dir(spark, "stage_table") + "/{account}/{zone}"
    day = date(2024, 1, 31)
    events = read(spark, sf_dir, "events")
    land_raw(events, "lake", "events", day, uri)
    database, _ = fresh_database(spark, "stage_table")
    return stage_table(spark, "lake", "events", day, "events_tmp", database, uri)


def page_of(key: Column, status: Column, first_day: date) -> dict[str, Column]:
    """Page number, status directory and one of three day directories."""
    return {
        "orderStatus": F.coalesce(status, F.lit("Open")),
        "fromDate": F.date_add(F.lit(first_day), (key % 3).cast("int")),
        "page": F.floor(key / (PAGE_LINES * 3)),
    }


def lines_for_pages(lines: DataFrame, first_day: date, *more: str) -> DataFrame:
    """Bronze lines with what ``page_of`` says."""
    place = page_of(F.col("polExternalID").cast("bigint"), F.col("catOrderStatus"), first_day)
    return lines.select(*SOURCE_COLUMNS, *more, *(c.alias(name) for name, c in place.items()))


# Every so many lines have a field the schema does not name, a nested object, no carrier name.
NEW_FIELD, NESTED, MISSING = 7, 5, 11


def _pages_sql() -> str:
    names = [c for c in SOURCE_COLUMNS if c != "carrierName"]
    broken = ["cast(p_partkey as varchar)" if c == "polExternalID" else "null" for c in names]
    return with_(
        f"{BRONZE}, numbered as (select *, cast(polExternalID as bigint) as k from bronze)",
        f"""select {', '.join(names)}, case when k % {MISSING} <> 0 then carrierName end as carrierName,
        case when k % {NEW_FIELD} = 0 then 'new ' || polExternalID end as added,
        case when k % {NESTED} = 0 then '{{"code":"' || carrierCode || '","legs":[1,2]}}' end as route,
        coalesce(catOrderStatus, 'Open') as "orderStatus",
        date '2024-01-01' + cast(k % 3 as integer) as "fromDate" from numbered
        union all
        select {', '.join(broken)}, 'whole', null, '{{"code":"a","at":{{"z":[1]}}}}', 'Open',
        date '2024-01-02' from part""",
    )


def some_pages(spark: SparkSession, sf_dir: str) -> str:
    """Sound pages and pages that break off; returns their folder."""
    path = run_dir(spark, "json_pages")
    key = F.col("polExternalID").cast("bigint")
    legs = F.struct(F.col("carrierCode").alias("code"), F.array(F.lit(1), F.lit(2)).alias("legs"))
    lines = bronze_table(spark, sf_dir).withColumns(
        {
            "carrierName": F.when(key % MISSING != 0, F.col("carrierName")),
            "added": F.when(key % NEW_FIELD == 0, F.concat(F.lit("new "), "polExternalID")),
            "route": F.when(key % NESTED == 0, legs),
        }
    )
    write_pages(lines_for_pages(lines, date(2024, 1, 1), "added", "route"), path, "page")
    broken = read(spark, sf_dir, "part").select(
        F.concat(
            F.lit('{"partOrderLines":[{"polExternalID":"'),
            F.col("p_partkey").cast("string"),
            F.lit('","carrierName":"whole","route":{"code":"a","at":{"z":[1]}}},{"polExternalID":"cut off",'),
            # Inside a nested object, and after one.
            F.when(F.col("p_partkey") % 2 == 0, '"route":{"code":"x","at":{"z":[{"polExternalID":"inner"},')
            .otherwise('"route":{"code":"x"},"carri'),
        ).alias("value"),
        F.lit("Open").alias("orderStatus"),
        F.lit("2024-01-02").alias("fromDate"),
    )
    broken.write.partitionBy("orderStatus", "fromDate").mode("append").text(path)
    return path


@query("json_pages", _pages_sql(), fixture=some_pages)
def json_pages(spark: SparkSession, path: str) -> DataFrame:
    """Lines of sound pages with all their fields, and the whole lines of pages that break off."""
    found = page_lines(read_pages(spark, path, as_of=date(2024, 1, 3)), LINE_SCHEMA)
    other = F.col(UNKNOWN)
    return found.withColumns({"added": other["added"], "route": other["route"]}).drop(UNKNOWN)


# Lines of a day on a page; every so many pages (by number, remainder) have the fault.
CHAINED_LINES = 20
LOST, TWICE, FORKED, CUT_OFF, WITHOUT, MERGED = (7, 3), (7, 5), (11, 4), (13, 6), (17, 8), (19, 9)


def _chains_sql() -> str:
    def hit(fault: tuple[int, int]) -> str:
        return f"page % {fault[0]} = {fault[1]}"

    each = "s, d"
    return with_(
        f"""{BRONZE}, numbered as (
        select coalesce(catOrderStatus, 'Open') as s, date '2024-01-01' + cast(k % 3 as integer) as d,
          k // {CHAINED_LINES * 3} as page
        from (select catOrderStatus, cast(polExternalID as bigint) as k from bronze)),
        ordered as (select distinct s, d, page from numbered),
        chained as (select {each}, page,
          coalesce('r' || lag(page) over (partition by {each} order by page), '') as a,
          case when lead(page) over (partition by {each} order by page) is null then '' else 'r' || page end as g
          from ordered),
        kept as (select * from chained where not {hit(LOST)}),
        pages as (
          select {each}, case when {hit(WITHOUT)} then null else a end as a, case when {hit(CUT_OFF)} then null else g end as g
            from kept
          union all select {each}, a, g from kept where {hit(TWICE)} and not {hit(CUT_OFF)} and not {hit(WITHOUT)}
          union all select {each}, a, 'x' || page from kept where {hit(FORKED)}
          union all select {each}, 'y' || page, 'r' || page from kept where {hit(MERGED)}),
        linked as (select * from pages where a is not null)""",
        """select s as "orderStatus", d as "fromDate", fault, cursor as "lastRecordID", n_pages from (
        select s, d, 'unlinked' as fault, null as cursor, count(*) as n_pages from pages where a is null group by s, d
        union all
        select s, d, 'missing start', '', 0 from linked group by s, d having count(*) filter (where a = '') = 0
        union all
        select s, d, 'missing before', a, count(*) from linked p where a <> '' and not exists
          (select 1 from linked q where q.s = p.s and q.d = p.d and q.g = p.a) group by s, d, a
        union all
        select s, d, 'missing after', g, count(*) from linked p where g <> '' and not exists
          (select 1 from linked q where q.s = p.s and q.d = p.d and q.a = p.g) group by s, d, g
        union all
        select s, d, 'fork', a, count(*) from linked group by s, d, a having count(distinct g) > 1
        union all
        select s, d, 'merge', g, count(*) from linked where g <> '' group by s, d, g having count(distinct a) > 1
        union all
        select s, d, 'broken', a, count(*) from linked where g is null group by s, d, a
        union all
        select s, d, 'repeated', a, cast(sum(n) as bigint) from (select s, d, a, g, count(*) as n from linked
          where g is not null group by s, d, a, g having count(*) > 1) group by s, d, a)""",
    )


def chained_pages(spark: SparkSession, sf_dir: str) -> str:
    """Pages linked by cursors, with pages lost, repeated, forked, merged, cut off and unlinked."""
    path = run_dir(spark, "chained_pages")
    key, group = F.col("polExternalID").cast("bigint"), ("orderStatus", "fromDate")
    lines = lines_for_pages(bronze_table(spark, sf_dir), date(2024, 1, 1)).withColumn(
        "page", F.floor(key / (CHAINED_LINES * 3))
    )
    order = Window.partitionBy(*group).orderBy("page")
    pages = lines.groupBy(*group, "page").agg(F.collect_list(F.struct("polExternalID")).alias("partOrderLines"))

    def record(mark: str, page: Column) -> Column:
        return F.concat(F.lit(mark), page.cast("string"))

    def hit(fault: tuple[int, int]) -> Column:
        return F.col("page") % fault[0] == fault[1]

    kept = pages.withColumns(
        {
            "asked": F.coalesce(record("r", F.lag("page").over(order)), F.lit("")),
            "given": F.when(F.lead("page").over(order).isNull(), "").otherwise(record("r", F.col("page"))),
        }
    ).filter(~hit(LOST))

    def text(asked: Column, given: Column) -> Column:
        return F.to_json(F.struct(asked.alias("afterRecordID"), "partOrderLines", given.alias("lastRecordID")))

    asked, given = F.col("asked"), F.col("given")
    own = text(F.when(~hit(WITHOUT), asked), given)
    # Broken off inside the lines, before the page's own cursor.
    own = F.when(hit(CUT_OFF), F.regexp_extract(own, '^(.*"polExternalID":")', 1)).otherwise(own)
    written = F.array(
        own,
        F.when(hit(TWICE) & ~hit(CUT_OFF) & ~hit(WITHOUT), own),
        F.when(hit(FORKED), text(asked, record("x", F.col("page")))),
        F.when(hit(MERGED), text(record("y", F.col("page")), record("r", F.col("page")))),
    )
    texts = kept.select(*group, F.explode(F.array_compact(written)).alias("value"))
    texts.write.partitionBy(*group).text(path)
    return path


@query("page_gaps", _chains_sql(), fixture=chained_pages)
def page_gaps(spark: SparkSession, path: str) -> DataFrame:
    """Where the pages of a status and day, linked by their cursors, don't make one chain."""
    return chain_faults(read_pages(spark, path))


@query(
    "flatten_struct",
    """select l_orderkey, l_quantity as item_quantity, l_extendedprice as item_price_gross,
       l_discount as item_price_discount, l_returnflag as item_flag from lineitem""",
)
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(
            F.col("l_quantity").alias("quantity"),
            F.struct(
                F.col("l_extendedprice").alias("gross"), F.col("l_discount").alias("discount")
            ).alias("price"),
            F.col("l_returnflag").alias("flag"),
        ).alias("item"),
    )
    return flatten_structs(nested, separator="_")


@query(
    "seed_status",
    with_(
        f"{BRONZE}, seed as ({SEED}), counted as (select trim(status) as status, count(*) as n "
        "from bronze group by 1)",
        """select s.sequence, s.status, coalesce(c.n, 0) as n_lines
        from seed s left join counted c on s.status = c.status""",
    ),
)
def seed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded seed with the number of bronze lines of each status."""
    database, location = fresh_database(spark, "seed_status")
    path = write_status_seed(spark, f"{location}/statuses_csv")
    seed = load_seed(
        spark, path, f"{location}/statuses", "statuses", database, database_location=location
    )
    lines = bronze(spark, sf_dir, "status").groupBy(F.trim("status").alias("status"))
    return seed.join(lines.agg(F.count("*").alias("n")), "status", "left").select(
        "sequence", "status", F.coalesce("n", F.lit(0)).alias("n_lines")
    )


@query(
    "dtype_schema",
    """select event_id, ts, cast(user_id as integer) as user_id, event_type,
       cast(value as double) as value, props from events""",
)
def dtype_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as text and typed by a mapping of pandas dtypes."""
    schema = schema_from_dtypes(
        {
            "event_id": "int64",
            "ts": "datetime64[ns]",
            "user_id": "int32",
            "event_type": "object",
            "value": "float64",
            "props": "object",
        }
    )
    text = read(spark, sf_dir, "events").select(
        *(F.col(f.name).cast("string").alias(f.name) for f in schema)
    )
    return text.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
