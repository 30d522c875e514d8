"""The daily job over two days."""

import dataclasses
import random
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, functions as F

from conftest import bag, plan
from lineforge.plans import daily, gold, quality, silver, upkeep
from lineforge.plans.columns import BRONZE_COLUMNS
from lineforge.sources import pages
from lineforge.sources.files import write_parquet
from lineforge.sources.pages import write_pages
from lineforge.sources.seeds import write_status_seed
from lineforge.sources.tables import BUCKET, buckets_in, scan_table
from lineforge.sources.zones import land_raw
from lineforge.workload.jobs import AS_OF, prepare_lake
from lineforge.workload.sql import WEIGHTS


def lines(spark, ids, status, day, page=0, **values):
    base = {
        "transportMode": "AIR", "orderType": "EMERGENCY", "orderEntryDate": "01/02/2024",
        "shippedPGIDate": "2024-01-05", "estimatedShipDate": "2024-01-09", "status": "Shipped",
        "facilityName": "North", "pendingItemQuantity": "2", "orderedQuantity": "4",
    } | values
    return spark.createDataFrame([(str(i),) for i in ids], "polExternalID string").select(
        "polExternalID",
        *(F.lit(v).alias(k) for k, v in base.items()),
        F.lit(status).alias("orderStatus"),
        F.lit(day).alias("fromDate"),
        F.lit(page).alias("page"),
    )


def lake(spark, folder, name, **settings):
    return daily.Lake(
        account="a", pages=f"{folder}/pages", seed=write_status_seed(spark, f"{folder}/seed"),
        uri=folder + "/{account}/{zone}", bronze=f"{name}_bronze", silver=f"{name}_silver",
        gold=f"{name}_gold", **settings,
    )


def test_two_days(spark, folder):
    where = lake(spark, folder, "two", snapshot_buckets=4)
    first = lines(spark, range(6), "Open", "2024-01-09").unionByName(
        lines(spark, [4, 5], "Closed", "2024-01-10", pendingItemQuantity="0")
    )
    write_pages(first, where.pages, "page")
    tables = daily.run(spark, where, WEIGHTS, "2024-01-10 01:20:32", bootstrap=True)
    assert bag(tables["bronze.parts"].groupBy("catOrderStatus").count()) == [("Closed", 2), ("Open", 4)]
    assert bag(tables["gold.factEmergencyOrder"]) == [("North", "EMERGENCY", 8)]
    assert tables["gold.deliveryprediction"].count() == 6
    assert set(buckets_in(scan_table(spark, "parts", "two_bronze"))) <= set(range(4))

    second = lines(spark, range(5, 9), "Open", "2024-01-11", shippedPGIDate="2024-01-11",
                   estimatedShipDate="2024-01-12", pendingItemQuantity="1")
    write_pages(second, where.pages, "page")
    tables = daily.run(spark, where, WEIGHTS, "2024-01-11 01:20:32", tests_first=True)
    rows = {r.polExternalID: r for r in where.bronze_parts(spark).collect()}
    assert len(rows) == 9
    assert rows["5"].insertDateTime == "2024-01-10T09:20:32"
    assert rows["5"].changedDateTime == "2024-01-11T09:20:32"
    assert rows["8"].insertDateTime == "2024-01-11T09:20:32" and rows["8"].changedDateTime is None
    predicted = tables["gold.deliveryprediction"]
    # Line 5 was scored the day before; 6, 7 and 8 are new and shipped after that scoring.
    assert bag(predicted.groupBy("Prediction_Datetime").count()) == [
        ("2024-01-10 01:20:32", 6), ("2024-01-11 01:20:32", 3),
    ]
    assert tables["gold.factparts"].filter("status_code = 5").count() == 9

    again = daily.run(spark, where, WEIGHTS, "2024-01-11 01:20:32")
    assert again["bronze.parts"].count() == 9
    assert again["gold.deliveryprediction"].count() == 9
    assert {p.name for p in Path(folder, "a/raw/parts").iterdir()} == {"20240110", "20240111"}


def test_windows_bound_what_is_read(spark, folder):
    where = lake(spark, folder, "bound", bad_pages=0.5)
    write_pages(
        lines(spark, [1], "Open", "2024-01-07").unionByName(lines(spark, [2], "Open", "2024-01-08")),
        where.pages, "page",
    )
    Path(where.pages, "orderStatus=Open/fromDate=2024-01-08/bad.json").write_text("{oops")
    daily.ingest(spark, where, "2024-01-10 01:20:32")
    assert bag(scan_table(spark, "parts", "bound_bronze"), "polExternalID") == [("2",)]
    assert daily.unreadable(spark, where, "2024-01-10 01:20:32").count() == 1
    assert daily.unreadable(spark, where, "2024-01-12 01:20:32").count() == 0
    strict = dataclasses.replace(where, bad_pages=0.01)
    with pytest.raises(daily.DamagedPages, match="1 of 2"):
        daily.ingest(spark, strict, "2024-01-10 01:20:32")


def test_missing_pages_stop_the_run_where_chains_must_be_whole(spark, folder):
    where = lake(spark, folder, "chains", whole_chains=True)
    fetched = [
        lines(spark, range(9 * i + 3 * p, 9 * i + 3 * p + 3), status, f"2024-01-{day:02d}", page=p)
        for i, (status, day) in enumerate((s, d) for s in ("Open", "Closed") for d in (8, 9, 10))
        for p in range(3)
    ]
    write_pages(reduce(DataFrame.unionByName, fetched), where.pages, "page", linked=True)
    assert daily.incomplete(spark, where, "2024-01-10 01:20:32").count() == 0
    daily.ingest(spark, where, "2024-01-10 01:20:32")
    assert where.bronze_parts(spark).count() == 54
    assert bag(daily.incomplete(spark, where, "2024-01-11 01:20:32"), "orderStatus", "fault") == [
        ("Closed", "missing start"), ("Open", "missing start"),
    ]
    write_pages(
        fetched[0].unionByName(fetched[2]).withColumn("fromDate", F.lit("2024-01-10")), where.pages, "page", linked=True
    )
    with pytest.raises(daily.MissingPages, match="missing start"):
        daily.ingest(spark, where, "2024-01-11 01:20:32")


def test_cold_start_scores_nothing_unless_told(spark, folder):
    where = lake(spark, folder, "cold")
    write_pages(lines(spark, range(3), "Open", "2024-01-10"), where.pages, "page")
    tables = daily.run(spark, where, WEIGHTS, "2024-01-10 01:20:32")
    assert tables["gold.deliveryprediction"].count() == 0
    failed = tables["checks"].filter(~F.col("passed")).select("check_name").collect()
    assert [r[0] for r in failed] == ["not_null"]  # the pages hold no isPurged


def test_raw_keeps_fields_the_schema_does_not_name(spark, folder):
    where = lake(spark, folder, "wide")
    more = lines(spark, range(3), "Open", "2024-01-10").withColumn("size", F.struct(F.lit(1).alias("w")))
    write_pages(more, where.pages, "page")
    daily.ingest(spark, where, "2024-01-10 01:20:32")
    assert len(where.bronze_parts(spark).columns) == 48
    raw = spark.read.parquet(folder + "/a/raw/parts/*/parts.snappy.parquet")
    assert bag(raw.select("otherFields.size")) == [('{"w":1}',)] * 3
    report = daily.run(spark, where, WEIGHTS, "2024-01-13 01:20:32")["checks"]
    assert bag(report.filter("check_name = 'freshness'"), "failures", "passed") == [(1, False)]


def test_files_per_bucket_stay_one(spark, folder):
    where = lake(spark, folder, "ten", snapshot_buckets=4, most_runs=0)
    for day in range(10, 20):
        new = range(day * 10, day * 10 + 30)
        write_pages(lines(spark, new, "Open", f"2024-01-{day}"), where.pages, "page")
        daily.ingest(spark, where, f"2024-01-{day} 01:20:32")
        merged = where.bronze_parts(spark)
        assert len(merged.inputFiles()) == 4
    assert merged.count() == 120 and BUCKET not in merged.columns


def changed_lines(spark, rng, day):
    """A batch of a third of 60 keys, and a row without a key, with values that move between groups."""
    rows = []
    for key in [*map(str, rng.sample(range(60), 20)), " 7", None]:
        rows.append(
            {c: None for c in BRONZE_COLUMNS}
            | {
                "polExternalID": key, "facilityName": rng.choice(["North", "South", " East", None]),
                "carrierCode": rng.choice(["c1", " c1 ", "c2", None]), "carrierName": rng.choice(["A", "B", None]),
                "orderType": rng.choice(["EMERGENCY", "STOCK"]), "pendingItemQuantity": rng.choice(["1", "2.5", "x", None]),
                "status": rng.choice(["Shipped", "Sourced", "?"]), "insertDateTime": f"2024-01-{day}",
                "isPurged": rng.choice(["true", None]), "pso": rng.choice(["12345678", "1"]), "shipByDate": rng.choice(["1/2/2024", None]),
            }
        )
    return spark.createDataFrame(rows, daily.BRONZE_SCHEMA)


def test_ten_days_of_upkeep_equal_full_builds(spark, folder):
    where = lake(spark, folder, "upkeep", snapshot_buckets=2)
    rng, status = random.Random(11), spark.createDataFrame([(5, "Shipped"), (4, "Sourced")], "sequence int, status string")

    def kept(name, frame):
        return write_parquet(frame, f"{folder}/{name}")

    where.snapshot.create(changed_lines(spark, rng, 10))
    parts = silver.silver_parts(where.bronze_parts(spark))
    where.fact_lines.create(daily._fact_with_key(daily._silver_with_key(where.bronze_parts(spark)), status))
    carriers, centers = kept("carriers10", upkeep.carrier_counts(parts)), kept("centers10", upkeep.center_sums(parts))
    counts, repeated = kept("counts10", upkeep.check_counts(parts)), kept("repeated10", upkeep.repeated_keys(parts))
    files = set(where.snapshot.base(spark).inputFiles())
    for day in range(11, 21):
        remembered = (*upkeep.REMEMBERED, *upkeep.CHECKED)
        changes = where.snapshot.upsert(changed_lines(spark, rng, day), remember=remembered)
        where.fact_lines.append_run(daily._fact_with_key(daily._silver_with_key(changes), status))
        carriers = kept(f"carriers{day}", upkeep.carriers_after(carriers, changes))
        centers = kept(f"centers{day}", upkeep.centers_after(centers, changes))
        parts = silver.silver_parts(where.bronze_parts(spark))
        assert bag(upkeep.dim_carrier(carriers)) == bag(gold.dim_carrier(parts))
        assert bag(upkeep.fact_emergency_order(centers)) == bag(gold.fact_emergency_order(parts))
        counts = kept(f"counts{day}", upkeep.check_counts_after(counts, changes))
        repeated = kept(f"repeated{day}", upkeep.repeated_keys_after(repeated, parts, changes))
        found = upkeep.check_report(counts, repeated)
        assert bag(found, *found.columns) == bag(quality.report(parts), *found.columns)
        assert bag(where.fact(spark)) == bag(gold.fact_parts(parts, status))
        assert "parts/version" not in plan(upkeep.carriers_after(carriers, changes))
    assert set(where.snapshot.base(spark).inputFiles()) == files


def test_after_a_run_that_broke_off_all_is_built_anew(spark, folder):
    where = lake(spark, folder, "broke")
    write_pages(lines(spark, range(4), "Open", "2024-01-10"), where.pages, "page")
    daily.run(spark, where, WEIGHTS, "2024-01-10 01:20:32")
    write_pages(lines(spark, [2], "Closed", "2024-01-11", facilityName="South"), where.pages, "page")
    daily.ingest(spark, where, "2024-01-11 01:20:32")  # and no more of that day
    write_pages(lines(spark, [3], "Closed", "2024-01-12", pendingItemQuantity="9"), where.pages, "page")
    assert daily.built_from(spark, where) != where.snapshot.version(spark)
    tables = daily.run(spark, where, WEIGHTS, "2024-01-12 01:20:32")
    assert bag(tables["gold.factEmergencyOrder"]) == [("North", "EMERGENCY", 13), ("South", "EMERGENCY", 2)]


def test_a_changed_lookup_builds_the_fact_anew(spark, folder):
    where = lake(spark, folder, "lookup")
    write_pages(lines(spark, range(4), "Open", "2024-01-10"), where.pages, "page")
    daily.run(spark, where, WEIGHTS, "2024-01-10 01:20:32")
    spark.createDataFrame([("9", "Shipped")], "sequence string, status string").coalesce(1).write.mode(
        "overwrite").option("header", True).csv(where.seed)
    write_pages(lines(spark, [3], "Closed", "2024-01-11"), where.pages, "page")
    tables = daily.run(spark, where, WEIGHTS, "2024-01-11 01:20:32")
    assert bag(tables["gold.factparts"], "status_code") == [(9,)] * 4


def test_a_day_of_sound_pages_runs_no_python(spark, small, monkeypatch):
    """Workers would stay on the executors, beside their heaps."""

    def refuse(*_, **__):
        raise AssertionError("rows pass Python")

    monkeypatch.setattr(pages, "whole_lines", refuse)
    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    where = prepare_lake(spark, small)
    assert daily.run(spark, where, WEIGHTS, AS_OF, bootstrap=True)["raw.unreadable"].count() == 0


def test_pages_are_read_few_at_a_time(spark, folder, monkeypatch):
    seen = []

    def landed(df, *rest):
        seen.append(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
        return land_raw(df, *rest)

    monkeypatch.setattr(daily, "land_raw", landed)
    where = lake(spark, folder, "few", bad_pages=0.5)
    write_pages(lines(spark, range(3), "Open", "2024-01-10"), where.pages, "page")
    Path(where.pages, "orderStatus=Open/fromDate=2024-01-10/bad.json").write_text(
        '{"partOrderLines":[{"polExternalID":"9"},{"polExternalID":"1'
    )
    tables = daily.run(spark, where, WEIGHTS, "2024-01-10 01:20:32")
    assert seen == [str(daily.PAGES_READ)] and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
    assert bag(tables["bronze.parts"], "polExternalID") == [("0",), ("1",), ("2",), ("9",)]
    assert bag(tables["raw.unreadable"], "legible_lines") == [(1,)]
