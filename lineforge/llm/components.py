"""Connected components over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.session import run_dir


def split_join(rows: DataFrame, key: str, few: DataFrame, of: str) -> DataFrame:
    """``rows`` joined to ``few``, an aggregate that has one row for each value of ``of``.

    A join right above an aggregate of its own key takes over the aggregate's partitions,
    which adaptive execution leaves whole. So the key's hash is a second key: both sides
    then come to the join from a shuffle, a frequent key's rows are split, and its one row of
    ``few`` is repeated for each part. Null keys are dropped.
    """
    few = few.withColumn("_hash", F.xxhash64(of))
    return rows.join(few, (rows[key] == few[of]) & (F.xxhash64(rows[key]) == few["_hash"])).drop(few["_hash"])


def large_star(rows: DataFrame) -> DataFrame:
    """Join each node's greater neighbours to the least of its neighbours and itself."""
    both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    higher = split_join(both.where(F.col("v") > F.col("u")), "u", least, "w")
    return higher.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(rows: DataFrame) -> DataFrame:
    """Join each node's lesser neighbours and itself to the least; rows have their greater node first."""
    least = rows.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    lower = split_join(rows, "u", least, "w")
    moved = lower.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the component's smallest node.

    Alternates the two star steps of Kiveris et al. (2014) until the edges stay the same;
    each round is written to the shared folder, so lineage stays short and a lost executor
    costs a round at most. A node's neighbours are never gathered: their minimum is an
    aggregate, and the join back to them may be split by adaptive execution, see ``split_join``. Only a count
    and a checksum reach the driver. Edges may repeat, loops are ignored, nulls dropped.
    """
    folder = run_dir(spark, "components")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}"
        frame.write.parquet(path)
        return spark.read.parquet(path)

    def state(frame: DataFrame) -> tuple:
        checksum = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        return tuple(frame.agg(F.count("*"), checksum).first())

    rows = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        edges[a].isNotNull() & edges[b].isNotNull() & (edges[a] != edges[b])
    )
    rows, turn = kept(rows.distinct(), "0"), 0
    before = state(rows)
    while before[0]:
        turn += 1
        rows = kept(small_star(large_star(rows)), str(turn))
        after = state(rows)
        if after == before:
            break
        before = after
    members = rows.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
