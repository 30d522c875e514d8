from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from conftest import bag
from lineforge.operators import columns as ops
from lineforge.operators.unions import union_pages


def test_clean_columns(spark):
    df = spark.range(1).toDF("a b.c[](d)\r")
    assert ops.clean_columns(df).columns == ["a_b_cd"]
    assert ops.clean_name("a____b") == "a__b"


def test_clean_columns_refuses_a_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, a_b int")
    with pytest.raises(ValueError, match="a_b"):
        ops.clean_columns(df)


def test_add_metadata(spark):
    row = ops.add_metadata(spark.range(1), "src", as_of="2024-01-01 20:00:00").first()
    assert row["md_Date"] == datetime(2024, 1, 2, 4) and row["SourceSystem"] == "src"
    assert ops.add_metadata(spark.range(1), "src").first()["md_Date"] is not None


def test_apply_schema_trims_casts_and_keeps_order(spark):
    df = spark.createDataFrame([(" 1.9 ", "x", " 2.5")], "a string, b string, c string")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("c", T.DoubleType())])
    done = ops.apply_schema(df, schema)
    assert done.columns == ["a", "b", "c"] and tuple(done.first()) == (1, "x", 2.5)


def test_nan_to_null_touches_floats_only(spark):
    df = spark.createDataFrame([(float("nan"), 1.0, "NaN", None)], "a double, b float, c string, d double")
    df = ops.add_metadata(df, "s", "2024-01-01 00:00:00")
    row = ops.nan_to_null(df).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (None, 1.0, "NaN", None)
    assert row["md_Date"] is not None


def test_void_to_string(spark):
    nothing = F.lit(None)
    df = spark.range(1).select(
        "id",
        nothing.alias("v"),
        F.array(nothing).alias("w"),
        F.struct(F.lit(True).alias("voided"), F.struct(nothing.alias("x")).alias("y")).alias("s"),
        F.struct(F.lit(1).alias("voided")).alias("t"),
        F.create_map(F.lit("k"), nothing).alias("m"),
    )
    done = ops.void_to_string(df)
    assert dict(done.dtypes) == {
        "id": "bigint", "v": "string", "w": "array<string>", "m": "map<string,string>",
        "s": "struct<voided:boolean,y:struct<x:string>>", "t": "struct<voided:int>",
    }
    assert done.first()["s"]["voided"] is True


def test_flatten_structs(spark):
    df = spark.createDataFrame(
        [((1, (2, [3, 4])), "x"), (None, "y")],
        "a struct<b:int,c:struct<d:int,e:array<int>>>, f string",
    )
    flat = ops.flatten_structs(df)
    assert flat.columns == ["a.b", "a.c.d", "a.c.e", "f"]
    assert [tuple(r) for r in flat.collect()] == [(1, 2, [3, 4], "x"), (None, None, None, "y")]


def test_schema_from_dtypes(spark):
    pdf = pd.DataFrame(
        {"i": [1], "f": [0.1], "s": ["x"], "t": [pd.Timestamp("2024-01-01")], "b": [True]}
    ).astype({"t": "datetime64[ns]"})
    df = spark.createDataFrame(pdf, ops.schema_from_dtypes(pdf.dtypes))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "timestamp", "boolean"]
    narrowed = ops.schema_from_dtypes({"f": "float64"}, single_precision=True)
    assert narrowed["f"].dataType == T.FloatType()


def test_union_goes_by_name(spark):
    a = spark.createDataFrame([("x", 1)], "s string, n int")
    b = spark.createDataFrame([(2, "y")], "n int, s string")
    c = spark.createDataFrame([("z",)], "s string").withColumn("n", F.lit(None))
    assert bag(union_pages([a, b, c])) == [("x", 1), ("y", 2), ("z", None)]
    with pytest.raises(ValueError):
        union_pages([])


def test_stamp_provenance(spark):
    row = ops.stamp_provenance(spark.range(1), "Open", "2024-01-31 23:00:00").first()
    assert (row["catOrderStatus"], row["insertDateTime"]) == ("Open", "2024-02-01T07:00:00")
