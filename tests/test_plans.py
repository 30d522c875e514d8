"""What the physical plans must and must not contain."""

import re
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F, types as T

import lineforge
from conftest import bag, plan
from lineforge.plans.columns import LINE_SCHEMA
from lineforge.plans.delivery import features
from lineforge.plans.gold import fact_emergency_order
from lineforge.session import MAX_FIELDS, SHUFFLE_CLEANUP, writing
from lineforge.sources.files import write_parquet
from lineforge.sources.pages import page_lines, read_pages
from lineforge.sources.runs import RunTable
from lineforge.sources.tables import BUCKET, scan_table
from lineforge.workload.all import QUERIES
from lineforge.workload.bronze import bronze
from lineforge.workload.jobs import prepare_lake
from lineforge.workload.learning import fact_of
from lineforge.workload.models import silver_of

SOURCES = [
    f for f in Path(lineforge.__file__).parent.rglob("*.py") if "llm" not in f.parts
]


def test_no_driver_data_path():
    for file in SOURCES:
        text = file.read_text()
        assert "toPandas" not in text
        assert ".rdd" not in text and "crossJoin" not in text
    collecting = {f.name for f in SOURCES if re.search(r"\.collect\(\)", f.read_text())}
    # A table description and the numbers of buckets, and the comparison tool.
    assert collecting == {"tables.py", "compare.py"}


def test_broadcast_hints_are_bounded():
    """There are none: Spark decides by measured size."""
    assert not [f.name for f in SOURCES if "F.broadcast(" in f.read_text()]


def test_emergency_is_a_top_k_over_a_pruned_scan(spark, small):
    text = plan(QUERIES["gold_emergency"](spark, small))
    assert "TakeOrderedAndProject(limit=10" in text
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1
    (schema,) = re.findall(r"ReadSchema: struct<(.*?)>", text)
    columns = {field.split(":")[0] for field in schema.split(",")}
    assert columns == {"pendingItemQuantity", "orderType", "facilityName"}


def test_having_is_below_the_aggregate_and_in_the_scan(spark, small, folder):
    parts = write_parquet(silver_of(spark, small), folder + "/silver")
    text = plan(fact_emergency_order(parts))
    aggregate = text.rindex("HashAggregate")
    assert "= EMERGENCY)" in text[aggregate:]
    (pushed,) = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)
    assert "EqualTo(ORDERTYPE,EMERGENCY)" in pushed and "IsNotNull(FACILITYNAME)" in pushed


def test_features_push_their_filters(spark, small, folder):
    fact = write_parquet(fact_of(spark, small), folder + "/fact")
    text = plan(features(fact))
    assert "IsNotNull(transportmode)" in text and "IsNotNull(estimatedshipdate)" in text
    assert "Exchange" not in text


def test_fact_broadcasts_the_small_lookup(spark, small):
    assert "BroadcastHashJoin [STATUS" in plan(QUERIES["gold_factparts"](spark, small))


def test_anti_join_is_not_null_aware(spark, small):
    text = plan(QUERIES["not_in_anti"](spark, small))
    assert "LeftAnti" in text and "BroadcastNestedLoopJoin" not in text
    assert re.search(r"LeftAnti, BuildRight, false", text) or "SortMergeJoin" in text


def test_window_filter_reaches_the_scan(spark, small):
    text = plan(QUERIES["window_select"](spark, small))
    assert "GreaterThanOrEqual(ts,2024-01-13" in text and "LessThan(ts,2024-01-16" in text


def test_fetch_windows_prune_directories(spark, folder):
    line = T.StructType([T.StructField("id", T.StringType())])
    for day in ("2024-01-01", "2024-01-09"):
        at = Path(folder, "orderStatus=Open", f"fromDate={day}")
        at.mkdir(parents=True)
        (at / "p.json").write_text('{"partOrderLines":[{"id":"1"}]}')
    lines = page_lines(read_pages(spark, folder, as_of=date(2024, 1, 10)), line)
    assert re.search(r"PartitionFilters: \[[^\]]*fromDate#\d+ >= 2024-01-08", plan(lines))
    assert lines.count() == 1


def test_latest_row_is_limited_before_the_shuffle(spark, small):
    text = plan(QUERIES["dedupe_latest"](spark, small))
    assert "row_number(), 1, Partial" in text
    assert text.index("Exchange") < text.index("Partial")


def test_bronze_is_dealt_out_before_its_columns_are_made(spark, small):
    text = plan(bronze(spark, small, "polExternalID", "carrierName", "facilityName", dealt=True))
    made, dealt = text.index("CARRIER "), text.index("REPARTITION_BY_COL")
    assert made < dealt and "CARRIER " not in text[dealt:]


def test_bronze_is_dealt_out_as_asked_before_its_columns_are_made(spark, small):
    def deal(orders):
        return orders.withColumn("part", F.col("k") % 4).repartition(6, "part")

    lines = bronze(spark, small, "polExternalID", "carrierName", dealt=deal, where="d < date '2000-01-01'")
    text = plan(lines)
    assert text.index("CARRIER ") < text.index("REPARTITION_BY_NUM") and lines.columns[-1] == "part"
    every = bronze(spark, small, "polExternalID", "carrierName", "createdDateTime").filter("createdDateTime < '2000-01-01'")
    assert bag(lines, "polExternalID", "carrierName") == bag(every, "polExternalID", "carrierName")


def test_the_lake_is_prepared_from_narrow_shuffles(spark, small):
    lake = prepare_lake(spark, small)
    later = bronze(spark, small).filter("createdDateTime >= '1999-01-01'")
    found = page_lines(read_pages(spark, lake.pages), LINE_SCHEMA)
    assert bag(found, "polExternalID", "shipId", "carrierName") == bag(later, "polExternalID", "shipId", "carrierName")
    assert all(name.endswith(".json.gz") for name in read_pages(spark, lake.pages).inputFiles())
    earlier = bronze(spark, small).filter("createdDateTime < '2000-01-01'")
    kept = scan_table(spark, "parts", lake.bronze)
    assert bag(kept.drop(BUCKET)) == bag(earlier)
    assert bag(lake.layout.assign(kept.drop(BUCKET)), "polExternalID", BUCKET) == bag(kept, "polExternalID", BUCKET)


def test_a_single_run_is_not_shuffled(spark, folder):
    columns = "polExternalID string, v int, insertDateTime string, changedDateTime string"
    table = RunTable("lines", "single_run", f"{folder}/lines", "polExternalID", folder)
    table.create(spark.createDataFrame([(str(i), i, "d0", None) for i in range(20)], columns))
    table.upsert(spark.createDataFrame([("3", -1, "d1", None)], columns))
    assert "Window" not in plan(table.content(spark))
    table.upsert(spark.createDataFrame([("3", -2, "d2", None)], columns))
    assert "Window" in plan(table.content(spark))
    assert bag(table.content(spark).filter("v < 0"), "polExternalID", "v") == [("3", -2)]


def test_report_is_one_pass_plus_unique(spark, small):
    assert plan(QUERIES["dq_report"](spark, small)).count("FileScan") == 2




def test_wide_rows_are_written_without_one_method_for_a_stage(spark):
    """Such methods are large, and so is what compiling them takes beside an executor's heap."""
    narrow = spark.range(9).selectExpr("id", "id + 1 as a").filter("a > 3")
    wide = spark.range(9).selectExpr(*(f"cast(id + {i} as string) as c{i}" for i in range(48))).filter("c7 > '3'")
    with writing(spark):
        assert re.search(r"\*\(\d\) Project", plan(narrow)) and not re.search(r"\*\(\d\) Project", plan(wide))
    assert re.search(r"\*\(\d\) Project", plan(wide.select("*")))
    assert spark.conf.get(MAX_FIELDS) == "100" and spark.conf.get(SHUFFLE_CLEANUP) == "false"
