"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become whole numbers x; each distinct one counts once. The leading eigenvectors of
their covariance V are found without forming V: a block Q of a few columns more than are
wanted is multiplied by V in passes over the centred vectors, XᵀXQ / n, each task adding up
its own vectors. A polynomial of Chebyshev in V, by its three-term recurrence, grows what
belongs to the wanted end of the spectrum and damps the rest; the block is made orthonormal
by QR and turned to the eigenvectors within its span by Rayleigh-Ritz, until the residuals
of the wanted ones certify them. The bounds of the unwanted part come from a short Lanczos
run and from the block's own last values.

The driver holds blocks of dimension by columns, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineforge.llm.names import col, free_names
from lineforge.session import run_dir

COMPONENTS = 16
GUARD = 16  # columns of the block beyond the wanted ones
SCALE, OFFSET = 64, 1_000_000
BLOCK_ENTRIES = 1 << 18  # numbers of a written block of vectors: 2 MB
LANCZOS = 10
DEGREE = 12
CERTIFIED = 1e-13  # residual of an eigenvector, against the largest eigenvalue
GOOD_ENOUGH = 1e-10  # where rounding keeps residuals from falling further
TURNS = 60
RANK_TOLERANCE = 1e-12  # eigenvalues below this share of the largest are taken for zero


class NotCertified(ArithmeticError):
    """Residuals did not fall to what certifies the eigenvectors."""


def as_whole(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of each entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of equal length as the rows of an array."""
    return np.asarray(column.flatten()).reshape(-1, width)


def _blocks(vectors: DataFrame, width: int) -> DataFrame:
    """(n, x): vectors of ``width`` whole numbers packed in blocks of bytes."""
    rows = max(1, BLOCK_ENTRIES // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            held, count = [*held, x], count + len(x)
            if count >= rows:
                yield packed(held)
                held, count = [], 0
        if count:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array([len(x)], type=pa.int64()), pa.array([x.tobytes()])], names=["n", "x"])

    return vectors.mapInArrow(run, "n long, x binary")


@dataclass(frozen=True)
class Centre:
    """The number of vectors and their sums."""

    n: int
    sums: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact, as whole numbers; Python's own where 64 bits may not do."""
        if np.abs(x).max(initial=0) > (1 << 61) // self.n:
            return x.astype(object) * self.n - self.sums
        return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)


@dataclass(frozen=True)
class Fit:
    """The distinct vectors: written blocks, dimension, and their centre."""

    blocks: DataFrame
    width: int
    centre: Centre

    @property
    def n(self) -> int:
        return self.centre.n

    def totals(self, per_block, shape: tuple[int, int]) -> np.ndarray:
        """The sum over all blocks of what a function of the centred vectors gives.

        A task adds up its blocks and sends one row for each row of the result.
        """
        width, n, centred = self.width, self.n, self.centre.of
        names = [f"c{j}" for j in range(shape[1])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for raw in batch.column("x"):
                    x = np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(-1, width)
                    total += per_block(centred(x).astype(float) / n)
            columns = [pa.array(np.arange(shape[0], dtype=np.int32)), *(pa.array(total[:, j].copy()) for j in range(shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", *names])

        schema = "i int, " + ", ".join(f"{c} double" for c in names)
        sent = self.blocks.select("x").mapInArrow(run, schema)
        out = np.zeros(shape)
        for row in sent.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect():
            out[row["i"]] = row[1:]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q in one pass over the vectors."""
        n = self.n
        shared = self.blocks.sparkSession.sparkContext.broadcast(q)
        try:
            return self.totals(lambda c: c.T @ (c @ shared.value) / n, q.shape)
        finally:
            shared.unpersist()


def fit_list(spark: SparkSession, whole: DataFrame, vector: str = "x") -> Fit:
    """Each distinct vector once, packed and written; sums are exact.

    Equal vectors are brought together by Spark's own aggregate, so a vector that many
    rows hold is counted in their tasks first.
    """
    path = run_dir(spark, "whitening")
    widths = whole.groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n"))
    first = widths.orderBy(F.col("n").desc(), F.col("width").desc()).first()
    width = first["width"] if first else 0
    if not width:
        nothing = spark.createDataFrame([], "n long, x binary")
        return Fit(nothing, 0, Centre(0, np.zeros(0, dtype=object)))
    _blocks(whole.where(F.size(vector) == width).select(vector).distinct(), width).write.parquet(path)
    blocks = spark.read.parquet(path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Halves of 32 bits: their sums stay exact where that of whole numbers may not.
        low, high, n = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64), 0
        for batch in batches:
            for raw in batch.column("x"):
                x = np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(-1, width)
                low, high, n = low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(low), pa.array(high)],
            names=["i", "n", "low", "high"],
        )

    rows = blocks.select("x").mapInArrow(sums, "i int, n long, low long, high long")
    rows = rows.groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "low", "high"))).collect()
    total = np.array([int(r["low"]) + (int(r["high"]) << 32) for r in sorted(rows, key=lambda r: r["i"])], dtype=object)
    return Fit(blocks, width, Centre(int(rows[0]["n"]), total))


def _lower_bound(fit: Fit, seed: np.ndarray) -> float:
    """A number that hardly any eigenvalue is below: the least Ritz value of a Lanczos run less its residual."""
    q, steps, alphas, betas = seed / np.linalg.norm(seed), [], [], []
    for _ in range(min(LANCZOS, fit.width)):
        steps.append(q)
        v = fit.times(q[:, None])[:, 0]
        alphas.append(float(q @ v))
        basis = np.array(steps).T
        v -= basis @ (basis.T @ v)
        v -= basis @ (basis.T @ v)
        betas.append(float(np.linalg.norm(v)))
        if betas[-1] <= 1e-14 * max(abs(alphas[0]), 1e-300):
            break
        q = v / betas[-1]
    tri = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) + np.diag(betas[: len(alphas) - 1], -1)
    values, vectors = np.linalg.eigh(tri)
    return max(0.0, float(values[0] - abs(betas[-1] * vectors[-1, 0])))


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues, falling, with their eigenvectors as columns and how they were certified."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def leading(fit: Fit, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> Spectrum:
    """The ``wanted`` leading eigenvectors of the covariance, certified by their residuals.

    Where dimension is no more than the block's columns, the block spans everything and one
    Rayleigh-Ritz step is exact. Raises ``NotCertified`` after ``TURNS`` turns.
    """
    wanted = min(wanted, fit.width)
    columns = min(fit.width, wanted + guard)
    draw = np.random.default_rng(20240131)
    q = np.linalg.qr(draw.standard_normal((fit.width, columns)))[0]
    passes, low, best = 0, 0.0, math.inf
    if columns < fit.width:
        low = _lower_bound(fit, draw.standard_normal(fit.width))
        passes += LANCZOS
    for _ in range(TURNS):
        vq = fit.times(q)
        passes += 1
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(values[0], 0.0)
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
        small = residual / top if top > 0 else 0.0
        if small <= CERTIFIED or columns == fit.width or (small <= GOOD_ENOUGH and small > best / 2):
            return Spectrum(values[:wanted], q[:, :wanted], small, passes)
        best = min(best, small)
        high = float(values[-1])
        low = min(low, high * 0.5) if high <= low else low
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-14 * top)
        # Scaled so that the leading value's growth stays near one (Zhou and Saad 2007).
        sigma = first = half / (top - centre)
        before, now = q, (vq - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            moved = fit.times(now) - centre * now
            passes += 1
            before, now = now, 2 * (after / half) * moved - sigma * after * before
            sigma = after
        q = np.linalg.qr(now)[0]
    raise NotCertified(f"residual {best:.1e} after {passes} passes")


def whiten(
    spark: SparkSession,
    rows: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    wanted: int = COMPONENTS,
    guard: int = GUARD,
) -> DataFrame:
    """One row per vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows without a vector, with an empty one, or with null or non-finite entries go. If
    lengths differ, the commonest counts (the longest of several) and other rows go.
    Repeated rows stay; the fit counts each distinct vector once. ``n`` vectors were fitted;
    ``deviation`` sums the squares of n x - S, null if 64 bits can't hold it. ``whitened``
    is the centred vector's projection over the root of the component's eigenvalue,
    ``explained`` the eigenvalue's share of the trace, ``identity_error`` how far the
    whitened fit's covariance is from the identity at most. Directions without variance
    are no components: equal vectors only give no rows, nor does an empty table.
    """
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    (kept,) = free_names(names, key)
    whole = rows.where(usable(col(vector))).select(col(key).alias("id"), as_whole(col(vector)).alias("x"))
    fit = fit_list(spark, whole)
    kind = whole.schema["id"].dataType
    schema = T.StructType(
        [T.StructField(kept, kind), *T.StructType.fromDDL(
            "component int, n long, deviation long, whitened double, explained double, identity_error double"
        ).fields]
    )
    if not fit.n:
        return spark.createDataFrame([], schema)
    found = leading(fit, wanted, guard)
    real = found.values > RANK_TOLERANCE * max(float(found.values[0]), 0.0)
    values, vectors = found.values[real], found.vectors[:, real]
    count, width, n = len(values), fit.width, fit.n
    if not count:
        return spark.createDataFrame([], schema)
    project = vectors / np.sqrt(values)
    shared = spark.sparkContext.broadcast(project)
    # One more pass over the fit: the trace, and the covariance of what is whitened.
    check = fit.totals(lambda c: _moments(c, shared.value), (count + 1, count))
    trace, covariance = float(check[count, 0]), check[:count] / n
    explained = values * n / trace
    error = float(np.abs(covariance - np.eye(count)).max())
    centred = fit.centre.of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_ENTRIES // (4 * width))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                d = centred(_matrix(part.column("x"), width))
                scores = (d.astype(float) / n) @ shared.value
                m = part.num_rows
                at = np.repeat(np.arange(m), count)
                columns = [
                    part.column("id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, n, dtype=np.int64)),
                    pa.array(_squares(d), type=pa.int64()).take(pa.array(at)),
                    pa.array(scores.reshape(-1)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * count, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return whole.where(F.size("x") == width).mapInArrow(run, schema)


def _moments(c: np.ndarray, project: np.ndarray) -> np.ndarray:
    """W'W of the projected vectors, and below it the sum of squares of all entries."""
    w = c @ project
    out = np.zeros((project.shape[1] + 1, project.shape[1]))
    out[:-1] = w.T @ w
    out[-1, 0] = np.square(c).sum()
    return out


def _squares(d: np.ndarray) -> list[int | None] | np.ndarray:
    """The sum of squares of each row, null where 64 bits can't hold it."""
    largest = int(np.abs(d).max(initial=0))
    if largest * largest * d.shape[1] < 1 << 63:
        return np.square(d).sum(axis=1)
    exact = [sum(int(v) * int(v) for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
