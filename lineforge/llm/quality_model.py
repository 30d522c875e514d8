"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of the transformed statistics. Covariances shrink
towards the pooled one and that towards a multiple of the identity; their Cholesky factors
are computed once and kept in the model, so a log density is one triangular product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.llm.arrow import SpanHashes, by_bytes, text_bytes, words
from lineforge.llm.names import col, narrowed
from lineforge.session import run_dir

TO_POOLED = 0.2  # share of the pooled covariance in that of a class
TO_IDENTITY = 0.1  # share of the mean variance in the result
TEMPERATURE = 2.0  # statistics aren't quite Gaussian; log densities are divided by this
THRESHOLD = 0.7
WINDOW = 5

FEATURES = (
    "log_words",
    "log_word_bytes",
    "spread_word_bytes",
    "distinct_words",
    "most_common_word",
    "repeated_windows",
    "repeated_lines",
    "log_words_per_line",
    "marks",
    "calls",
    "sentence_ends",
    "commas",
    "digits",
    "upper",
    "non_ascii",
    "marked_words",
)

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[np.frombuffer(b"#*$%&|<>@^~=+_{}[]\\/", dtype=np.uint8)] = 1
_KIND[np.frombuffer(b"!?", dtype=np.uint8)] = 2
_KIND[np.frombuffer(b".", dtype=np.uint8)] = 3
_KIND[np.frombuffer(b",;:", dtype=np.uint8)] = 4
_KIND[48:58] = 5
_KIND[65:91] = 6
_KIND[97:123] = 7
_KIND[128:] = 8


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a smoothed share; texts with nothing to count come near that of one half a case."""
    part = np.minimum(part, whole)
    return np.log((part + 0.5) / (whole - part + 20.0))


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics of whole texts, a row of ``FEATURES`` each; null counts as empty."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    found = words(data, offsets)
    row, n_words = found.row, np.diff(found.first).astype(float)
    sizes = (found.ends - found.starts).astype(float)
    bytes_in = np.bincount(row, weights=sizes, minlength=n)
    squares = np.bincount(row, weights=sizes * sizes, minlength=n)
    some = np.maximum(n_words, 1)
    mean = bytes_in / some
    spread = np.sqrt(np.maximum(squares / some - mean * mean, 0))

    hashes = SpanHashes(data)
    salt = row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    word = hashes.of(found.starts, found.ends)
    _, first, count = np.unique(word ^ salt, return_index=True, return_counts=True)
    distinct = np.bincount(row[first], minlength=n)
    common = np.zeros(n)
    np.maximum.at(common, row[first], count)

    repeats = np.zeros(n)
    last = len(row) - WINDOW + 1
    if last > 0:
        window = np.zeros(last, dtype=np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + word[k : k + last]
            window ^= window >> np.uint64(29)
        at = np.flatnonzero(row[:last] == row[WINDOW - 1 :])
        _, begins = np.unique(window[at] ^ salt[at], return_index=True)
        windows = np.bincount(row[at], minlength=n)
        repeats = windows - np.bincount(row[at][begins], minlength=n)

    feeds = np.flatnonzero(data == 0x0A)
    line_row = np.sort(np.concatenate((np.arange(n), np.searchsorted(offsets, feeds, side="right") - 1)))
    line_begins = np.sort(np.concatenate((offsets[:-1], feeds + 1)))
    line_ends = offsets[1:][line_row].copy()
    inner = line_row[1:] == line_row[:-1]
    line_ends[:-1][inner] = line_begins[1:][inner] - 1
    full = np.searchsorted(found.starts, line_ends) > np.searchsorted(found.starts, line_begins)
    line_row, key = line_row[full], hashes.of(line_begins[full], line_ends[full])
    _, first = np.unique(key ^ (line_row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    lines = np.bincount(line_row, minlength=n)
    repeated_lines = lines - np.bincount(line_row[first], minlength=n)

    kind = _KIND[data]
    at_row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(at_row * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
    letters = kinds[:, 6] + kinds[:, 7]
    marked = np.bincount(row, weights=(kind[found.ends - 1] == 1) | (kind[found.ends - 1] == 2), minlength=n)
    return np.column_stack(
        [
            np.log1p(n_words),
            np.log1p(mean),
            np.log1p(spread),
            _share(distinct, n_words),
            _share(common, n_words),
            _share(repeats, n_words),
            _share(repeated_lines, lines),
            np.log1p(n_words / np.maximum(lines, 1)),
            _share(kinds[:, 1], bytes_in),
            _share(kinds[:, 2], bytes_in),
            _share(kinds[:, 3], bytes_in),
            _share(kinds[:, 4], bytes_in),
            _share(kinds[:, 5], bytes_in),
            _share(kinds[:, 6], letters),
            _share(kinds[:, 8], bytes_in),
            _share(marked, n_words),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and constants; empty if a class had no rows."""

    means: tuple[np.ndarray, ...]
    inverses: tuple[np.ndarray, ...]
    constants: tuple[float, ...]
    prior: float

    @classmethod
    def fit(
        cls,
        moments: dict[int, tuple[float, np.ndarray, np.ndarray]],
        to_pooled: float = TO_POOLED,
        to_identity: float = TO_IDENTITY,
    ) -> Discriminant:
        """From each class's number of rows, sums, and sums of products."""
        n = [moments[c][0] if c in moments else 0.0 for c in (0, 1)]
        prior = (n[1] + 1) / (sum(n) + 2)
        if min(n) < 1:
            return cls((), (), (), prior)
        means = [moments[c][1] / n[c] for c in (0, 1)]
        covariances = [moments[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / sum(n)
        # The statistics differ in scale, so what stands for the identity is the pooled diagonal.
        diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
        inverses, constants = [], []
        for own in covariances:
            shrunk = (1 - to_pooled) * own + to_pooled * pooled
            factor = np.linalg.cholesky((1 - to_identity) * shrunk + to_identity * diagonal)
            inverses.append(np.linalg.inv(factor))
            constants.append(-float(np.log(np.diag(factor)).sum()))
        return cls(tuple(means), tuple(inverses), tuple(constants), prior)

    def score(self, rows: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
        """Probability of class 1 by the difference of the classes' log densities."""
        if not self.means:
            return np.full(len(rows), self.prior)
        density = [
            constant - 0.5 * np.square((rows - mean) @ inverse.T).sum(axis=1)
            for mean, inverse, constant in zip(self.means, self.inverses, self.constants, strict=True)
        ]
        log_odds = (density[1] - density[0]) / temperature + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))


def featurise(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and ``stats``, the statistics of each whole text."""
    narrow, kept, body, schema = narrowed(docs, keep, text, "stats array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, body):
                found = statistics(part.column(body))
                stats = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), stats.cast(pa.list_(pa.float64()))], names=schema.names
                )

    return narrow.mapInArrow(run, schema)


def fit(features: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id") -> Discriminant:
    """The discriminant of all labelled rows.

    ``features`` as from ``featurise``; ``labels`` holds the key and a label of 0 or 1 and
    only rows to learn from. Rows with another or no label are left out; a document with
    two labels counts with each. Sums and products are added up map-side, and as many
    numbers as the model has come to the driver.
    """
    size = len(FEATURES)
    known = labels.where(col(label).isin(0, 1)).select(col(key).alias("_id"), col(label).cast("int").alias("_label"))
    rows = features.select(col(key).alias("_key"), "stats").join(known, F.col("_key") == F.col("_id"))
    rows = rows.select("_label", "stats")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            of = np.asarray(batch.column("_label"))
            x = np.asarray(batch.column("stats").flatten()).reshape(-1, size)
            for c in (0, 1):
                own = x[of == c]
                totals[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        if totals[:, 0].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([0, 1], type=pa.int32()), pa.array(list(totals), type=pa.list_(pa.float64()))],
                names=["label", "totals"],
            )

    summed = (
        rows.mapInArrow(products, "label int, totals array<double>")
        .select("label", F.posexplode("totals").alias("at", "value"))
        .groupBy("label", "at")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    totals = np.zeros((2, 1 + size + size * size))
    for row in summed:
        totals[row["label"], row["at"]] = row["value"]
    moments = {c: (t[0], t[1 : 1 + size], t[1 + size :].reshape(size, size)) for c, t in enumerate(totals) if t[0]}
    return Discriminant.fit(moments)


def score(stats: Column, model: Discriminant) -> Column:
    """Score of a column of statistics."""

    @F.arrow_udf("double")
    def of(values: pa.Array) -> pa.Array:
        rows = np.asarray(values.flatten()).reshape(-1, len(FEATURES))
        return pa.array(model.score(rows))

    return of(stats)


def score_text(text: Column, model: Discriminant) -> Column:
    """Score of a text column, so that other columns need not pass through Python."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["body"])
        parts = [model.score(statistics(p.column(0))) for p in by_bytes(batch, "body")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return of(text)


def learnable(key: str = "doc_id") -> Column:
    """Rows the classifier may learn from: those whose id doesn't fall into the held-out quarter."""
    return F.crc32(F.col(key).cast("string")) % 4 != 2


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, Discriminant]:
    """Statistics of all documents, written to the shared folder, and the model learned from them."""
    path = run_dir(spark, "quality-statistics")
    featurise(docs).write.parquet(path)
    features = spark.read.parquet(path)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learnable())
    return features, fit(features, labels)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    features, model = trained(spark, docs, sf_dir)
    return features.select(
        "doc_id",
        F.coalesce(~learnable(), F.lit(False)).alias("held_out"),
        score(F.col("stats"), model).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below the threshold go."""
    _, model = trained(spark, docs, sf_dir)
    return docs.where(score_text(docs["text"], model) >= THRESHOLD)
