from datetime import date

import pytest
from pyspark.sql import functions as F, types as T

from lineforge.functions.casts import cast_text, strict_int, truncated_int
from lineforge.functions.categories import ORDER_TYPE_CODES, TRANSPORT_CODES, encode
from lineforge.functions.dates import days_between, iso_date, mixed_date_text, stamp_text
from lineforge.functions.defaults import legacy_default, legacy_pso
from lineforge.functions.predicates import unless


def apply(spark, expression, values, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    done = rows.select("i", expression(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(done)]


@pytest.fixture(params=["true", "false"], ids=["ansi", "lenient"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_truncated_int(spark, ansi):
    texts = [" 12 ", "1.5", "-2.9", "-0.5", "7.", "abc", "", "1e3", "99999999999", None, "+4"]
    texts += [".5", "-.9", "\t1.5", "\n 8.25\r", ".", "-.", "1.2.3", "+.0"]
    expected = [12, 1, -2, 0, 7, None, None, None, None, None, 4]
    expected += [0, 0, 1, 8, 0, 0, None, 0]
    assert apply(spark, truncated_int, texts) == expected


def test_truncated_int_agrees_with_the_lenient_cast(spark):
    texts = ["12", "1.5", "-2.9", "", "abc", "2147483647", "2147483648", "1.2.3", " 8", "--1", None]
    texts += [".5", "-.9", "\t1.5", "7.", ".", "-", "\t4\n"]
    mine = apply(spark, truncated_int, texts)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert mine == apply(spark, lambda c: c.cast("int"), texts)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_strict_int(spark):
    assert apply(spark, strict_int, [" 12 ", "1.5", "x", None]) == [12, None, None, None]


def test_cast_text(spark):
    assert apply(spark, lambda c: cast_text(c, T.DoubleType()), [" 1.5 ", "x"]) == [1.5, None]
    assert apply(spark, lambda c: cast_text(c, T.LongType()), [" 9.9 ", "x"]) == [9, None]
    assert apply(spark, lambda c: cast_text(c, T.BooleanType()), [" true", "maybe"]) == [True, None]


def test_mixed_date_is_text_whatever_the_setting(spark, ansi):
    texts = ["01/31/2024", " 2024-01-31 ", "13/45/2024", "junk", "", None]
    expected = ["2024-01-31", "2024-01-31", None, "junk", "", None]
    assert apply(spark, mixed_date_text, texts) == expected


def test_iso_date(spark, ansi):
    texts = ["2024-01-31T10:00:00", "2024-01-31", "01/31/2024", None]
    assert apply(spark, iso_date, texts) == [date(2024, 1, 31), date(2024, 1, 31), None, None]


def test_days_between(spark):
    rows = spark.createDataFrame(
        [(date(2024, 3, 1), date(2024, 2, 28)), (date(2024, 1, 1), None)], "a date, b date"
    )
    assert [r[0] for r in rows.select(days_between(F.col("a"), F.col("b"))).collect()] == [2, None]


def test_stamp_text_crosses_midnight(spark):
    row = spark.range(1).select(stamp_text("2024-01-31 20:00:01", 8, "yyyy-MM-dd'T'HH:mm:ss"))
    assert row.first()[0] == "2024-02-01T04:00:01"


def test_legacy_pso_pads_the_untrimmed_text(spark):
    rows = spark.createDataFrame(
        [("12345678", None), (" 12345678 ", None), ("12345678", "t"), (" 123 ", None), (None, None)],
        "pso string, at string",
    )
    padded = [r[0] for r in rows.select(legacy_pso(F.col("pso"), F.col("at"))).collect()]
    assert padded == ["012345678", "0 12345678 ", "12345678", "123", None]


def test_legacy_default_is_for_lines_without_insert_time(spark):
    rows = spark.createDataFrame(
        [(None, None), (None, "t"), (" x ", None), (" x ", "t")], "v string, at string"
    )
    filled = rows.select(legacy_default(F.col("v"), F.col("at"), "Open")).collect()
    assert [r[0] for r in filled] == ["Open", None, "x", "x"]


def test_encode(spark):
    assert apply(spark, lambda c: encode(c, TRANSPORT_CODES), ["TRUCK", "AIR", "SEA", None]) == [
        1, 2, None, None,
    ]
    assert apply(spark, lambda c: encode(c, ORDER_TYPE_CODES), ["STOCK", "LCPRO"]) == [1, 8]


def test_unless_keeps_unknown(spark):
    rows = spark.createDataFrame([(2, 1), (1, 2), (None, 1), (1, None)], "a int, b int")
    kept = rows.filter(unless(F.col("a") > F.col("b"))).collect()
    assert [tuple(r) for r in kept] == [(1, 2), (None, 1), (1, None)]
