"""Mixing sources to target weights by Pareto order sampling.

A source's target, in words, over its size says how many copies of each of its documents
the mix expects. The whole part is allocated to every document for certain. The fraction
left is an inclusion probability p, and what is left of the target is drawn by Pareto order
sampling (Rosén 1997): documents are ranked by the odds of a uniform number, which follows
from id and text, divided by the odds of their inclusion, smallest first.

A sample's size is fixed in words, as a target is, not in documents: the ranks are taken
while their words fit. A document that no longer fits is passed over, for up to ``FILL``
further ranks; later ones aren't taken. So a source misses its target by less than the
shortest document passed over, and never exceeds it.

No ranking sorts a source. Ranks z = odds / (1 + odds) lie between 0 and 1; the words in
each of ``PARTS`` equal parts of that range are summed, which tells the part where the
target is reached; that part is divided again until few ranks are left in it, and these
alone are looked at one by one. Rows that are equal in all that counts share a rank and are
counted, not gathered. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineforge.llm.names import col, free_names
from lineforge.session import run_dir

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix for each word of the sources
MOST = 2.0  # copies of a source that the mix may hold
FILL = 1000  # ranks tried after the first that doesn't fit
RANK_BITS = 48
PART_BITS = 12
PARTS = 1 << PART_BITS
FEW = 4096  # distinct ranks that may be looked at one by one, where ranks differ at all
WORD_AND_SPACE_BEFORE = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; null has none.

    Each run becomes one letter, so no array of words is made of a long text.
    """
    letters = F.rtrim(F.regexp_replace(text, WORD_AND_SPACE_BEFORE, "w"), F.lit(SPACE))
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def _written(spark: SparkSession, frame: DataFrame, folder: str, name: str) -> DataFrame:
    frame.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def _numbered(spark: SparkSession, sizes: DataFrame, folder: str) -> DataFrame:
    """Sources with their place by code point from 0, null last; no task sees all of them."""
    ordered = sizes.repartitionByRange(F.col("source").isNull(), F.col("source"))
    ordered = _written(spark, ordered.withColumn("part", F.spark_partition_id()), folder, "ordered")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task of the sort.
    starts = counts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    own = ordered.withColumn("place", F.row_number().over(inside) - 1)
    return own.join(starts, own["part"] == starts["of"]).select(
        "source", "source_size", (F.col("start") + F.col("place")).alias("place")
    )


def targets(
    spark: SparkSession,
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(source, source_size, target) for each row (source, source_size).

    Sources in order of code point, null last, have the weights in turn. They divide
    ``share`` times all words by weight; a target stops at ``most`` times the source's size
    and the excess is divided again among the others until none is above. With ``share``
    above ``most`` all stop. Each turn is one aggregate, of which one row reaches the driver.
    """
    folder = run_dir(spark, "mix-sources")
    listed = F.array(*(F.lit(float(w)) for w in weights))
    placed = _numbered(spark, sizes, folder).select(
        "source",
        "source_size",
        F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(most)).alias("cap"),
    )
    placed = _written(spark, placed, folder, "placed")
    budget = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        n, filled, free = placed.agg(
            F.count_if(full),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == stopped:
            break
        stopped, level = n, (budget - filled) / free if free else float("inf")
    return placed.select(
        "source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target")
    )


def rank_of(uniform: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds, q, as the whole number below 2**48 q / (1 + q)."""
    low, high = uniform * (1 - inclusion), (1 - uniform) * inclusion
    return F.least(
        F.floor(low / (low + high) * F.lit(float(1 << RANK_BITS))), F.lit((1 << RANK_BITS) - 1)
    ).cast("long")


def _bracket(spark: SparkSession, ranked: DataFrame, goals: DataFrame, folder: str, few: int, fill: int) -> DataFrame:
    """(of, low, high, room) for each source: the ranks to look at, and what they may take.

    All ranks below ``low`` are taken, none above ``high``. Each turn sums words by part of
    what the turn before left, map-side first; a source has at most ``PARTS`` rows then.
    """
    state = goals.select(
        F.col("source").alias("of"),
        F.col("goal").alias("room"),
        F.lit(0).cast("long").alias("low"),
        F.lit((1 << RANK_BITS) - 1).cast("long").alias("high"),
        F.lit(False).alias("done"),
    )
    state = _written(spark, state, folder, "bracket-0")
    for turn, shift in enumerate(range(RANK_BITS - PART_BITS, -1, -PART_BITS), 1):
        open_ones = state.where(~F.col("done"))
        inside = ranked.join(
            open_ones, ranked["source"].eqNullSafe(open_ones["of"]) & F.col("rank").between(F.col("low"), F.col("high"))
        )
        part = F.shiftright("rank", shift).alias("part")
        sums = inside.groupBy("of", "room", part).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = Window.partitionBy("of").orderBy("part")
        running = sums.select(
            "of", "room", "part", "n",
            F.sum("words").over(upto).alias("words_to"),
            F.sum("n").over(upto).alias("n_to"),
            (F.sum("words").over(upto) - F.col("words")).alias("words_before"),
            (F.sum("n").over(upto) - F.col("n")).alias("n_before"),
        )
        # The part that passes the room, and those whose ranks the fill may need.
        past = running.where(F.col("words_to") > F.col("room"))
        first = F.min(F.struct("part", "words_before", "n_before", "n"))
        cut = past.groupBy(F.col("of").alias("cut_of"), F.col("room").alias("cut_room")).agg(first.alias("c"))
        ends = running.join(
            cut, running["of"].eqNullSafe(cut["cut_of"]) & (F.col("n_before") < F.col("c.n_before") + F.col("c.n") + fill)
        ).groupBy("cut_of", "cut_room", "c")
        narrowed = ends.agg(F.max("part").alias("last")).select(
            F.col("cut_of").alias("of"),
            (F.col("cut_room") - F.col("c.words_before")).alias("room"),
            F.shiftleft(F.col("c.part"), shift).alias("low"),
            # While the part itself is too long only it is divided; else the fill's parts come with it.
            F.when(F.col("c.n") > few, F.shiftleft(F.col("c.part") + 1, shift) - 1)
            .otherwise(F.shiftleft(F.col("last") + 1, shift) - 1)
            .alias("high"),
            (F.col("c.n") <= few).alias("done"),
        )
        state = _written(spark, narrowed.unionByName(state.where("done")), folder, f"bracket-{turn}")
        if not state.where(~F.col("done")).take(1):
            break
    return state.drop("done")


def _first_fit(rows: Column, room: Column) -> Column:
    """How many of each entry (rank, key, size, n), in order, are taken while words fit."""

    def step(seen: Column, row: Column) -> Column:
        fits = F.when(row["size"] == 0, row["n"]).otherwise(F.floor(seen["room"] / row["size"]))
        taken = F.least(row["n"], fits)
        return F.struct(
            (seen["room"] - taken * row["size"]).alias("room"),
            F.concat(seen["taken"], F.array(taken)).alias("taken"),
        )

    start = F.struct(room.alias("room"), F.array().cast("array<bigint>").alias("taken"))
    return F.aggregate(rows, start, step)["taken"]


def mix(
    spark: SparkSession,
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    propensity: str | None = None,
    few: int = FEW,
    fill: int = FILL,
) -> DataFrame:
    """One row per document: its key, size, source_size, target, copies and taken.

    ``size`` counts words, runs of characters other than space and 0x09-0x0D; a null text
    has none. ``copies`` says how often the mix takes the document, ``taken`` is copies
    times size. ``propensity`` names a column of numbers above 0 by which documents of a
    source differ in their odds of the fractional copy, 1 where null; their expected copies
    are equal without it. A null source is a source of its own, last. Documents without
    words have only the certain copies. Rows with the same source, key, text and propensity
    share a rank, and as many of them are taken as fit. An empty table gives no rows. The
    result depends on the rows alone, not on their order or files.
    """
    folder = run_dir(spark, "mix")
    odds = F.lit(1.0) if propensity is None else F.coalesce(col(propensity).cast("double"), F.lit(1.0))
    id_text = F.coalesce(col(key).cast("string"), F.lit("~"))
    sized = docs.select(
        col(key).alias("id"),
        col(source).cast("string").alias("source"),
        word_count(col(text)).alias("size"),
        F.xxhash64(id_text, F.coalesce(col(text), F.lit(""))).alias("hash"),
        odds.alias("odds"),
        F.monotonically_increasing_id().alias("row"),
    )
    sized = _written(spark, sized, folder, "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = _written(spark, targets(spark, _written(spark, sizes, folder, "sizes"), weights, share, most), folder, "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.select(
        F.col("source").alias("of"), "source_size", "target",
        F.floor(ratio).alias("certain"),
        (ratio - F.floor(ratio)).alias("fraction"),
    )
    placed = sized.join(aims, sized["source"].eqNullSafe(aims["of"])).drop("of")
    # Odds of inclusion are those of the source's fraction times the document's own.
    lifted = F.col("fraction") * F.col("odds")
    inclusion = lifted / (lifted + 1 - F.col("fraction"))
    uniform = (F.shiftrightunsigned("hash", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    drawn = (F.col("fraction") > 0) & (F.col("size") > 0)
    placed = placed.select(
        "id", "source", "size", "hash", "row", "source_size", "target", "certain",
        F.when(drawn, rank_of(uniform, inclusion)).alias("rank"),
    )
    placed = _written(spark, placed, folder, "placed")
    ranked = placed.where(F.col("rank").isNotNull())
    goals = aims.where(F.col("fraction") > 0).select(
        F.col("of").alias("source"), (F.col("target") - F.col("certain") * F.col("source_size")).alias("goal")
    )
    bracket = _bracket(spark, ranked, goals, folder, few, fill)

    # The ranks in question, equal rows counted, and how many of each fit.
    near = placed.join(
        bracket,
        placed["source"].eqNullSafe(bracket["of"]) & F.col("rank").between(F.col("low"), F.col("high")),
    )
    same = ("source", "rank", "hash", "id", "size")
    entries = near.groupBy("room", *same).agg(F.count("*").alias("n"))
    entry = F.struct("rank", "hash", "id", "size", "n")
    listed = entries.groupBy("source", "room").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    fitted = listed.select("source", "rows", _first_fit(F.col("rows"), F.col("room")).alias("k"))
    fitted = fitted.select("source", F.inline(F.arrays_zip("rows", "k"))).select("source", "rows.*", "k")
    fitted = _written(spark, fitted, folder, "fitted")
    renamed = fitted.select(*(F.col(c).alias(f"f_{c}") for c in (*same, "n", "k")))

    def matched(rows: DataFrame, found: DataFrame) -> Column:
        names = ("source", "id", "size", "hash")
        test = rows["rank"] == found["f_rank"]
        for name in names:
            test = test & rows[name].eqNullSafe(found[f"f_{name}"])
        return test

    # Where some but not all of several equal rows fit, they are numbered within the tasks that read them.
    split = renamed.where((F.col("f_k") > 0) & (F.col("f_k") < F.col("f_n")))
    rows = placed.join(split, matched(placed, split)).withColumn("task", F.shiftright("row", 33))
    group = tuple(f"f_{c}" for c in same)
    per_task = rows.groupBy(*group, "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select(
        *(F.col(c).alias(f"s_{c}") for c in (*group, "task")), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "task").orderBy("row")))
    test = inside["task"] == starts["s_task"]
    for name in group:
        test = test & inside[name].eqNullSafe(starts[f"s_{name}"])
    chosen = inside.join(starts, test).where(F.col("start") + F.col("nth") <= F.col("f_k")).select(F.col("row").alias("chosen"))

    whole = renamed.where(F.col("f_k") == F.col("f_n"))
    chosen = chosen.unionByName(placed.join(whole, matched(placed, whole), "left_semi").select(F.col("row").alias("chosen")))
    limits = bracket.select(F.col("of").alias("b_of"), "low")
    known = placed.join(limits, placed["source"].eqNullSafe(limits["b_of"]), "left")
    known = known.join(chosen, known["row"] == chosen["chosen"], "left")
    # A source without a bracket fits whole.
    extra = (
        F.when(F.col("rank").isNull(), 0)
        .when(F.col("b_of").isNull() & F.col("low").isNull(), 1)
        .when(F.col("rank") < F.col("low"), 1)
        .when(F.col("chosen").isNotNull(), 1)
        .otherwise(0)
    )
    copies = (F.col("certain") + extra).cast("long")
    (kept,) = free_names(["size", "source_size", "target", "copies", "taken"], key)
    return known.select(
        F.col("id").alias(kept), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the copies that they follow from."""
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
