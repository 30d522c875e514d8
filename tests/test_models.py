"""Silver, gold, quality, delivery model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import bag, plan
from lineforge.operators.sampling import HOLDOUT_ROWS, holdout_head, holdout_tail
from lineforge.plans import delivery, gold, quality, silver
from lineforge.plans.columns import BRONZE_COLUMNS, SOURCE_COLUMNS
from lineforge.sources.seeds import SEED_SCHEMA, STATUSES
from lineforge.workload.compare import oracle_connection
from lineforge.workload.learning import features_of
from lineforge.workload.sql import FEATURES, with_


def bronze_rows(spark, *rows):
    schema = ", ".join(f"{c} string" for c in BRONZE_COLUMNS)
    return spark.createDataFrame([[r.get(c) for c in BRONZE_COLUMNS] for r in rows], schema)


def test_column_counts(spark):
    assert len(SOURCE_COLUMNS) == 45 and len(BRONZE_COLUMNS) == 48
    parts = silver.silver_parts(bronze_rows(spark, {}))
    assert len(parts.columns) == 48 and "DEALERCODE" in parts.columns
    assert sum(t == "int" for _, t in parts.dtypes) == 7
    assert sum(t == "string" for _, t in parts.dtypes) == 41


def test_silver_row(spark):
    row = silver.silver_parts(
        bronze_rows(
            spark,
            dict(pso="12345678", shippedPGIDate="02/03/2024", orderedQuantity="3.7",
                 customerCode=" c ", status=" Shipped "),
        )
    ).first()
    assert (row.PSO, row.SHIPPEDPGIDATE, row.ORDEREDQUANTITY) == ("012345678", "2024-02-03", 3)
    assert (row.ISPURGED, row.CATORDERSTATUS, row.DEALERCODE, row.STATUS) == (
        "false", "Open", "c", "Shipped",
    )


def parts_and_status(spark, *rows):
    status = silver.silver_status(spark.createDataFrame(STATUSES, SEED_SCHEMA))
    return silver.silver_parts(bronze_rows(spark, *rows)), status


def test_fact_status_codes(spark):
    parts, status = parts_and_status(
        spark, dict(polExternalID="1", status="Null"), dict(polExternalID="2"),
        dict(polExternalID="3", status="Unheard"), dict(polExternalID="4", status=" Griefed"),
    )
    fact = gold.fact_parts(parts, status)
    assert len(fact.columns) == 47 and "carriername" not in fact.columns
    assert bag(fact, "polexternalid", "status_code") == [
        ("1", 0), ("2", None), ("3", None), ("4", 7),
    ]


def test_fact_fans_out_on_a_repeated_status(spark):
    rows = [dict(polExternalID=str(i), status="Shipped") for i in range(40)]
    parts, status = parts_and_status(spark, *rows)
    doubled = status.unionByName(status)
    spread = gold.fact_parts(parts, doubled)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = gold.fact_parts(parts, doubled)
        assert spread.count() == 80 and bag(spread) == bag(shuffled)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_models_emit_the_contract_s_order(spark):
    parts, status = parts_and_status(spark, {})
    assert parts.columns[:9] == [
        "SOURCEDITEMQUANTITY", "RELEASEITEMQUANTITY", "PENDINGITEMQUANTITY", "ORDEREDQUANTITY",
        "MATERIALREQUESTQUANTITY", "INVOICEDITEMQUANTITY", "CUSTOMERSUPPLIEDITEMNUMBER",
        "TRANSPORTMODE", "TRACKINGNUMBER",
    ]
    assert parts.columns[-3:] == ["SHIPBYDATE", "INSERTDATETIME", "CHANGEDDATETIME"]
    fact = gold.fact_parts(parts, status)
    assert fact.columns[:5] == [
        "transportmode", "trackingnumber", "sourcedpartnumber", "status_code", "sourceditemquantity",
    ]


def test_dimcarrier_keeps_the_pair_of_nulls(spark):
    parts, _ = parts_and_status(
        spark, dict(carrierCode="1", carrierName="a "), dict(carrierCode="1", carrierName="a"), {}, {}
    )
    assert bag(gold.dim_carrier(parts)) == [("1", "a"), (None, None)]


def test_emergency_report(spark):
    rows = [
        dict(facilityName=f"F{i:02d}", orderType="EMERGENCY", pendingItemQuantity=str(i // 2))
        for i in range(14)
    ]
    rows += [dict(facilityName="F00", orderType="STOCK", pendingItemQuantity="999"),
             dict(orderType="EMERGENCY", pendingItemQuantity="999"),
             dict(facilityName="F13", orderType="EMERGENCY")]
    parts, _ = parts_and_status(spark, *rows)
    report = [tuple(r) for r in gold.fact_emergency_order(parts).collect()]
    assert len(report) == 10
    assert report[:3] == [("F12", "EMERGENCY", 6), ("F13", "EMERGENCY", 6), ("F10", "EMERGENCY", 5)]


def test_checks(spark):
    df = spark.createDataFrame(
        [("1", "01/02/2024", "12345678"), ("1", "2024-01-02", "123456789"), (None, None, None)],
        "k string, d string, p string",
    )
    assert quality.date_format(df, "d").count() == 1
    assert quality.length(df, "p", 8).count() == 1
    assert quality.not_null(df, "k").count() == 1
    assert bag(quality.unique(df, "k")) == [("1", 2)]
    assert quality.string_type(df, "k").count() == 0
    assert bag(quality.string_type(df.filter("false"), "k")) == [(0,)]
    assert bag(quality.string_type(df.withColumn("k", F.lit(None)), "k")) == [(0,)]


def test_report_agrees_with_the_single_checks(spark):
    parts, _ = parts_and_status(
        spark, dict(polExternalID="1", pso="12345678", insertDateTime="t", isPurged="true"),
        dict(polExternalID="1", insertDateTime="t"), dict(shipByDate="a/b/c"),
    )
    report = {(r.check_name, r.column_name): (r.failures, r.passed) for r in quality.report(parts).collect()}
    assert len(report) == len(quality.PARTS_CHECKS)
    single = {
        "date_format": lambda c: quality.date_format(parts, c.column),
        "length": lambda c: quality.length(parts, c.column, c.value),
        "not_null": lambda c: quality.not_null(parts, c.column),
        "unique": lambda c: quality.unique(parts, c.column),
        "string_type": lambda c: quality.string_type(parts, c.column),
    }
    for check in quality.PARTS_CHECKS:
        n = single[check.kind](check).count()
        assert report[check.kind, check.column] == (n, n == 0)
    assert report["unique", "POLEXTERNALID"] == (1, False)
    assert report["length", "PSO"] == (1, False)


def test_report_of_an_empty_table(spark):
    parts, _ = parts_and_status(spark, {})
    report = quality.report(parts.filter("false")).collect()
    assert {r.check_name for r in report if not r.passed} == {"string_type"}


@pytest.mark.parametrize(
    "as_of, offset, state",
    [("2024-01-02 00:00:00", 0, "pass"), ("2024-01-02 00:00:01", 0, "warn"),
     ("2024-01-03 00:00:01", 0, "error"), ("2024-01-01 16:00:01", 8, "warn")],
)
def test_freshness(spark, as_of, offset, state):
    texts = ["2024-01-01T00:00:00", "2023-01-01T00:00:00", None, "junk"]
    df = spark.createDataFrame([(t,) for t in texts], "at string")
    assert quality.freshness(df, "at", as_of, offset).first()["state"] == state
    assert quality.freshness(df.filter("false"), "at", as_of).first()["state"] == "error"


def fact_rows(spark, *rows):
    schema = """polexternalid string, transportmode string, ordertype string, orderentrydate string,
      orderedquantity int, shippedpgidate string, carriercode string, estimatedshipdate string"""
    return spark.createDataFrame(list(rows), schema)


def line(key, mode="AIR", kind="STOCK", entered="2024-01-01", quantity=1, shipped="2024-01-03",
         arrival="2024-01-05"):
    return (key, mode, kind, entered, quantity, shipped, "c", arrival)


def test_features(spark):
    fact = fact_rows(
        spark, line("ok"), line("late", shipped="2024-01-06"), line("unshipped", shipped=None),
        line("no mode", mode=None), line("no arrival", arrival=None), line("junk", arrival="soon"),
        line("odd", mode="SEA", kind="X"),
    )
    rows = {r.polExternalID: r for r in delivery.features(fact).collect()}
    assert set(rows) == {"ok", "unshipped", "junk", "odd"}
    ok = rows["ok"]
    assert (ok.DaysToShip, ok.DaysToDelivery, ok.transportModeCode, ok.orderTypeCode) == (2, 4, 2, 1)
    assert (rows["unshipped"].DaysToShip, rows["junk"].DaysToDelivery) == (None, None)
    assert (rows["odd"].transportModeCode, rows["odd"].orderTypeCode) == (None, None)


def random_fact(spark, n=400):
    rng = np.random.default_rng(0)
    rows = [
        line(str(i), mode=["AIR", "TRUCK", "SEA"][rng.integers(3)],
             kind=["STOCK", "FDO", "DOWN", "?"][rng.integers(4)], quantity=int(rng.integers(1, 60)),
             shipped=None if i % 11 == 0 else f"2024-01-{rng.integers(1, 9):02d}",
             arrival=f"2024-01-{rng.integers(9, 29):02d}")
        for i in range(n)
    ]
    return fact_rows(spark, *rows)


def design(rows):
    x = np.array([[1.0] + [float(r[f] or 0) for f in delivery.FEATURES] for r in rows])
    return x, np.array([float(r[delivery.LABEL]) for r in rows])


def test_fit_equals_least_squares_and_survives_saving(spark, folder):
    features = delivery.features(random_fact(spark))
    model = delivery.fit(features)
    x, y = design(features.collect())
    expected = np.linalg.lstsq(x, y, rcond=None)[0]
    weights = delivery.coefficients(model)
    assert np.allclose(list(weights.values()), expected, atol=1e-8)
    delivery.save_model(model, folder + "/m")
    loaded = delivery.predict(features, delivery.load_model(folder + "/m"))
    plain = delivery.predict(features, weights)
    assert loaded.columns == plain.columns == [*features.columns, delivery.PREDICTION]
    both = loaded.join(plain, "polExternalID").select(
        F.max(F.abs(loaded[delivery.PREDICTION] - plain[delivery.PREDICTION]))
    )
    assert both.first()[0] < 1e-4
    error = np.sqrt(np.mean((y - x @ expected) ** 2))
    assert abs(delivery.rmse(loaded).first()["rmse"] - error) < 1e-5


def test_moments(spark):
    features = delivery.features(random_fact(spark))
    x, y = design(features.collect())
    table = np.column_stack([x, y])
    names = ["intercept", *delivery.FEATURES, delivery.LABEL]
    gram = table.T @ table
    for row in delivery.moments(features).collect():
        assert row.sum_ab == gram[names.index(row.term_a), names.index(row.term_b)]


def test_the_job_s_holdout_on_a_larger_table(spark):
    """The last 10,000 feature rows, entry dates tied and missing, against the check engine."""
    large = "/root/testdata/sf0.1"
    rows = features_of(spark, large)
    head = holdout_head(rows, ("orderEntryDate", "polExternalID"), HOLDOUT_ROWS)
    tail = holdout_tail(rows, ("orderEntryDate", "polExternalID"), HOLDOUT_ROWS)
    sql = with_(
        f"""{FEATURES}, numbered as (select *, row_number() over
        (order by orderEntryDate desc nulls last, polExternalID desc) as n from features)""",
        """select count(*), sum(cast(polExternalID as bigint)), min(orderEntryDate) from numbered
        where n <= 10000 union all
        select count(*), sum(cast(polExternalID as bigint)), min(orderEntryDate) from numbered
        where n > 10000""",
    )
    key = F.sum(F.col("polExternalID").cast("bigint"))
    mine = [tuple(p.agg(F.count("*"), key, F.min("orderEntryDate")).first()) for p in (tail, head)]
    assert HOLDOUT_ROWS == mine[0][0] == 10_000
    assert mine == oracle_connection(large).execute(sql).fetchall()


def scored_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "polExternalID string, Prediction_Datetime string")


def keys(df):
    return sorted(r.polExternalID for r in df.collect())


def test_new_rows(spark):
    fact = fact_rows(
        spark, line("old", shipped="2024-01-01"), line("same day", shipped="2024-01-02"),
        line("new", shipped="2024-01-03"), line("done", shipped="2024-01-03"),
    )
    scored = scored_rows(spark, ("done", "2024-01-02 01:20:32"), ("x", "2024-01-01 01:20:32"))
    assert keys(delivery.new_rows_to_score(fact, scored)) == ["new"]
    with_null = scored.unionByName(scored_rows(spark, (None, "2024-01-01 00:00:00")))
    assert keys(delivery.new_rows_to_score(fact, with_null)) == []
    nothing = scored.filter("false")
    assert keys(delivery.new_rows_to_score(fact, nothing)) == []
    assert len(keys(delivery.new_rows_to_score(fact, nothing, bootstrap=True))) == 4


def test_the_watermark_reads_the_newest_day_only(spark, folder):
    fact = fact_rows(spark, line("a", shipped="2024-01-03"), line("b", shipped="2024-01-01"))
    scored = delivery.with_day(
        scored_rows(spark, ("x", "2024-01-02 01:20:32"), ("y", "2023-12-01 01:20:32"))
    )
    scored.write.partitionBy(delivery.SCORED_DAY).parquet(folder + "/scored")
    laid_out = spark.read.parquet(folder + "/scored")
    recent = delivery.after_watermark(
        delivery.extract(fact), laid_out, "shippedPGIDate", delivery.SCORED_AT
    )
    assert keys(recent) == ["a"]
    text = plan(recent)
    assert "PartitionFilters: [isnotnull(scored_day" in text and "Subquery" in text
    assert keys(delivery.new_rows_to_score(fact, laid_out)) == ["a"]


def test_scored_keys_outside_the_batch_are_passed_over(spark, folder):
    """The guard's search and the batch's ends reach the files of the prediction table."""
    scored = delivery.with_day(
        scored_rows(spark, ("a1", "2024-01-01 01:20:32"), ("b1", "2024-01-02 01:20:32"), ("c1", "2024-01-03 01:20:32"))
    )
    scored.write.partitionBy(delivery.SCORED_DAY).parquet(folder + "/scored")
    laid_out = spark.read.parquet(folder + "/scored")
    recent = spark.createDataFrame([("b0",), ("b1",), ("b2",), (None,)], "polExternalID string")
    fresh = delivery.not_scored(recent, laid_out, ("b0", "b2"))
    assert keys(fresh) == keys(delivery.not_scored(recent, laid_out)) == ["b0", "b2"]
    text = plan(fresh)
    assert "GreaterThanOrEqual(polExternalID,b0), LessThanOrEqual(polExternalID,b2)" in text
    assert "PushedFilters: [IsNull(polExternalID)]" in text
    # No other scan of the table names the key.
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "polExternalID" in line.split("Batched")[0]]
    assert all("GreaterThanOrEqual" in line or "IsNull" in line for line in scans)
    # A batch of null keys alone has no ends, and no row of it is new.
    nameless = recent.filter("polExternalID is null")
    assert delivery.not_scored(nameless, laid_out, (None, None)).count() == 0
    assert delivery.not_scored(nameless, laid_out.filter("false"), (None, None)).count() == 1


def test_empty_batch_appends_nothing(spark, folder):
    fact = fact_rows(spark, line("old", shipped="2024-01-01"))
    scored = scored_rows(spark, ("x", "2024-02-01 00:00:00"))
    weights = {"intercept": 0.0, **{f: 0.0 for f in delivery.FEATURES}}
    done = delivery.score_batch(fact, scored, weights, folder, "none", "no_database")
    assert done is scored and not spark.catalog.databaseExists("no_database")
    size = delivery.batch_size(delivery.new_rows_to_score(fact, scored)).first()
    assert tuple(size) == (0, True)


def test_rounds_come_near_least_squares_and_penalties_shrink(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        mode, kind, quantity, days = rng.choice([1, 2, None]), rng.randrange(1, 9), rng.randrange(1, 9), rng.randrange(10)
        label = 2 + 3 * (mode or 0) - kind + days
        rows.append((mode, kind, quantity, days, label if rng.random() < 0.9 else None))
    columns = "transportModeCode int, orderTypeCode int, orderedQuantity int, DaysToShip int, DaysToDelivery int"
    frame = spark.createDataFrame(rows, columns)
    exact = {"intercept": 2, "transportModeCode": 3, "orderTypeCode": -1, "orderedQuantity": 0, "DaysToShip": 1}
    near = delivery.fit_rounds(frame, rounds=3000)
    assert all(abs(near[k] - v) < 1e-6 for k, v in exact.items())
    few = delivery.fit_rounds(frame)
    assert 0.001 < max(abs(few[k] - v) for k, v in exact.items())
    assert abs(delivery.fit_rounds(frame, l2=10.0)["DaysToShip"]) < abs(few["DaysToShip"])
    assert delivery.fit_rounds(frame, rounds=400, l1=1e6)["orderTypeCode"] == pytest.approx(0)
    nothing = delivery.fit_rounds(frame.limit(0))
    assert nothing["intercept"] == delivery.BASE_SCORE and nothing["DaysToShip"] == 0
