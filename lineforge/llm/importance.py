"""Target-distribution importance resampling: documents that look like a target, by weight.

Features are a text's words and pairs of neighbouring words, hashed into ``BUCKETS``. How
often each bucket occurs in the corpus and in the target gives it a gain, the logarithm of
the smoothed ratio; a document's weight is the mean gain of its features. Random numbers
with Gumbel's distribution are added to the weights: the highest scores are then a sample
without replacement whose odds follow the weights (Xie et al. 2023).

Gains are one array of fixed length, by which tasks score whole texts. The cutoff is found
without sorting the corpus: a quantile sketch gives a bracket of scores around it, exact
counts of what lies outside tell whether the cutoff is inside, else the bracket is widened;
a bracket with many rows is sketched again, and only the last one is sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineforge.llm.arrow import by_bytes, lower, text_bytes
from lineforge.llm.names import col, free_names
from lineforge.session import run_dir

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SCALE = 1000
SKETCH_K = 400  # error of a rank in a sketch: some 0.7 %
MARGINS = tuple(0.01 * 2**i for i in range(8))  # half a bracket's width as a share of the rows; the last holds all
SORTED_AT_ONCE = 20_000

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[0x30:0x3A] = True
_IN_WORD[0x61:0x7B] = True
_IN_WORD[0x80:] = True

# CRC-32 as zlib has it: reflected, polynomial 0xEDB88320.
_POLYNOMIAL = 0xEDB88320
_SHORT = 48  # bytes of words whose checksums are made side by side; longer ones go one by one


def _byte_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(_POLYNOMIAL), values >> 1)
    return values


_TABLE = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, being b, becomes when n zero bytes follow."""
    tables = np.empty((_SHORT + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(_SHORT):
        tables[n + 1] = _TABLE[tables[n] & 0xFF] ^ (tables[n] >> 8)
    return tables


_SHIFTS = _shift_tables()


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in lower-cased bytes, and their rows."""
    inside = _IN_WORD[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[edges]
    stops[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes."""
    lengths = ends - starts
    state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    for k in range(min(_SHORT, int(lengths.max(initial=0)))):
        here = order[np.searchsorted(sorted_lengths, k, side="right") :]
        now = state[here]
        state[here] = _TABLE[(now ^ data[starts[here] + k]) & 0xFF] ^ (now >> 8)
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def _followed(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of two spans one after the other from those of both; ``lengths``: the second's, short ones."""
    out = second.copy()
    for k in range(4):
        out ^= _SHIFTS[lengths, k, (first >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the row of every feature of some texts, and the number of words by row."""
    data, offsets = text_bytes(column)
    data = lower(data)
    starts, ends, row = _spans(data, offsets)
    single = checksums(data, starts, ends)
    left = np.flatnonzero(row[1:] == row[:-1])
    lengths = (ends - starts)[left + 1]
    spaced = _followed(single[left], np.uint32(zlib.crc32(b" ")).repeat(len(left)), np.ones(len(left), dtype=np.int64))
    short = lengths <= _SHORT
    pairs = np.empty(len(left), dtype=np.uint32)
    pairs[short] = _followed(spaced[short], single[left + 1][short], lengths[short])
    for i in np.flatnonzero(~short):
        pairs[i] = zlib.crc32(data[starts[left[i] + 1] : ends[left[i] + 1]], int(spaced[i]))
    bucket = np.concatenate((single, pairs)) % np.uint32(buckets)
    return bucket, np.concatenate((row, row[left])), np.bincount(row, minlength=len(offsets) - 1)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in by_bytes(batch, "body"):
                counts += np.bincount(features(part.column("body"), buckets)[0], minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["bucket", "n"])

    sent = docs.select(col(text).cast("string").alias("body")).mapInArrow(run, "bucket int, n long")
    return sent.groupBy("bucket").agg(F.sum("n").alias("n"))


def _as_array(counts: DataFrame, buckets: int) -> list[int]:
    """The counts as an array: ``buckets`` numbers, however large the corpus."""
    out = [0] * buckets
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int], scale: int = SCALE) -> list[int]:
    """For each bucket the logarithm of its smoothed share in the target over that in the corpus, floored."""
    size, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return [
        math.floor(scale * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size))))
        for s, t in zip(corpus, target)
    ]


def weighted(docs: DataFrame, by_bucket: list[int], text: str, key: str) -> DataFrame:
    """(id, n_words, n_features, weight) of each row; a text without features weighs 0."""
    narrow = docs.select(col(key).alias("id"), col(text).cast("string").alias("body"))
    kind = narrow.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(by_bucket, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in by_bytes(batch, "body"):
                bucket, row, n_words = features(part.column("body"), len(known))
                rows = part.num_rows
                order = np.argsort(row, kind="stable")
                sums = np.concatenate(([0], np.cumsum(known[bucket[order]])))
                ends = np.cumsum(np.bincount(row, minlength=rows))
                n = np.diff(ends, prepend=0)
                total = sums[ends] - sums[ends - n]
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                numbers = [pa.array(np.asarray(x, dtype=np.int64)) for x in (n_words, n, mean)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *numbers], names=["id", "n_words", "n_features", "weight"]
                )

    return narrow.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int, scale: int = SCALE) -> Column:
    """A random number that follows from the key, floored after scaling; a null key counts as no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(uniform))).cast("long")


def cutoff(scores: DataFrame, place: int, score: str = "score", sorted_at_once: int = SORTED_AT_ONCE) -> int | None:
    """The ``place``-th highest score, exactly; null if there are fewer or ``place`` is below 1.

    Scores are whole numbers, without nulls. One sketch and one count for each turn reach
    the driver.
    """
    rows = scores.select(score)
    n, low, high = rows.agg(F.count("*"), F.min(score), F.max(score)).first()
    if place < 1 or place > n:
        return None
    above = 0  # rows above the bracket low..high, in which there are n
    while n > sorted_at_once and low < high:
        inside = rows.where(F.col(score).between(low, high))
        sketch = inside.agg(F.kll_sketch_agg_bigint(score, F.lit(SKETCH_K)).alias("sketch"))
        middle = 1 - (place - above - 0.5) / n
        ends = [min(max(middle + side * margin, 0.0), 1.0) for margin in MARGINS for side in (-1, 1)]
        found = list(sketch.select(*(F.kll_sketch_get_quantile_bigint("sketch", F.lit(e)) for e in ends)).first())
        for at in range(0, len(ends), 2):
            left = low if ends[at] == 0 else found[at]
            right = high if ends[at + 1] == 1 else found[at + 1]
            over, held = inside.agg(
                F.count_if(F.col(score) > right), F.count_if(F.col(score).between(left, right))
            ).first()
            if above + over < place <= above + over + held:
                break
        if (left, right) == (low, high):
            # A few values hold nearly all rows: halve the range of values instead.
            half = (low + high) // 2
            over = inside.where(F.col(score) > half).count()
            if above + over < place:
                high, above, n = half, above + over, n - over
            else:
                low, n = half + 1, over
        else:
            low, high, above, n = left, right, above + over, held
    if low == high:
        return low
    found = rows.where(F.col(score).between(low, high)).orderBy(F.col(score).desc()).limit(place - above)
    return found.agg(F.min(score)).first()[0]


def _ranked(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Rows (id, score, ..) with their place by falling score, then by id, nulls last.

    Sorted in ranges, each numbered by itself after the numbers of those before it.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    path = f"{folder}/ordered"
    rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    ordered = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = ordered.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return own.join(starts, own["part"] == starts["of"]).withColumn("rank", F.col("start") + F.col("nth"))


def resample(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = 7,
    sorted_at_once: int = SORTED_AT_ONCE,
) -> DataFrame:
    """One row per document: its key, n_features, weight, score and rank, null unless drawn.

    Words are runs of ASCII digits and letters and of all characters beyond ASCII, after
    A-Z are lower-cased; null texts have none, a text without words weighs 0. ``percent``
    of the documents with at least ``least_words`` words are drawn, rounded down: the
    highest scores, ties to the smaller key, nulls last. Repeated rows are documents of
    their own with the same score; of those on the cutoff as many are drawn as are due.
    Without targets or documents the counts are zeros; an empty table gives no rows.
    """
    folder = run_dir(spark, "importance")
    by_bucket = gains(
        _as_array(bucket_counts(docs, text), BUCKETS), _as_array(bucket_counts(target, target_text), BUCKETS)
    )
    scored = weighted(docs, by_bucket, text, key).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored.write.parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    able = scored.where(F.col("n_words") >= least_words)
    due = percent * able.count() // 100
    least = cutoff(able, due, sorted_at_once=sorted_at_once)
    taken = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    (kept,) = free_names(["n_features", "weight", "score", "rank"], key)
    columns = [F.col("id").alias(kept), "n_features", "weight", "score"]
    place = F.when(F.col("rank") <= due, F.col("rank")).cast("long").alias("rank")
    drawn = _ranked(spark, scored.where(taken), folder).select(*columns, place)
    return drawn.unionByName(scored.where(~taken).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(
        spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
