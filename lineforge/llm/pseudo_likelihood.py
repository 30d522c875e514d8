"""LM scoring by masked pseudo-likelihood.

A small network predicts every word from the two words on either side of it: position-wise
embeddings of the neighbours are added, go through tanh, and a two-level softmax gives the
class of the word and the word within the class. A document's score is the sum of its
words' conditional log probabilities.

The vocabulary comes from counts over the whole corpus: the most frequent words have ids of
their own, others share buckets. The number of ids grows with the square root of the number
of distinct words. A word in a bucket has the bucket's probability times its share of the
bucket's occurrences. The tasks know the counts of the ``KNOWN`` most frequent words; counts
of others come by a join with the written counts, so every word has its own.

Words are cut and looked up once; rounds and scoring read the written ids. Training goes
over all documents once, in rounds: in each, every learner starts from the common
parameters, trains on its part of the round's documents and sends its parameters, block by
block; the blocks are averaged by number of words. There are as many learners as cores, not
as files. Parameters grow as the ids do, far slower than the corpus, so they may come to the
driver and go to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineforge.llm.arrow import SpanHashes, by_bytes, lower, text_bytes, words
from lineforge.llm.names import col, free_names, narrowed
from lineforge.session import run_dir

LEAST_SIDE = 64  # classes, and ids in a class, of the smallest model
VOCABULARY = LEAST_SIDE**2  # its ids; the last class is for words that aren't among the most frequent
IDS_BY_ROOT = 8  # ids for each unit of the root of the number of distinct words
KNOWN = 1 << 18  # words whose counts the tasks have, at least all with ids of their own
BITS = 19  # leading bits of a hash by which it is looked up
STEPS = 8  # hashes that are passed one by one before the rest are searched for
UNSEEN = 0.5  # occurrences a word counts for that the corpus doesn't have
WIDTH = 16
SIDES = (-2, -1, 1, 2)
REACH = max(SIDES)
ROUNDS = 3
BATCH = 1024  # words in a training step
SCORED = 2048  # words scored at once
RATE = 0.15
BLOCK = 4096  # parameters in a block
MANY = 11  # rows that are summed by a product of their own


def side_of(distinct: int) -> int:
    """Number of classes, and of ids in each, for a corpus with that many distinct words."""
    return max(LEAST_SIDE, math.ceil(math.sqrt(IDS_BY_ROOT * math.sqrt(distinct))))


def _shapes(side: int) -> dict[str, tuple[int, ...]]:
    return {
        # A row holds a word's embeddings at all of SIDES; the last stands for what lies beyond a text's ends.
        "embedding": (side * side + 1, len(SIDES) * WIDTH),
        "bias": (WIDTH,),
        "classes": (WIDTH, side),
        "class_bias": (side,),
        "gate": (side, WIDTH),
        "words": (WIDTH, side),
        "word_bias": (side, side),
    }


def _columns(k: int) -> slice:
    """Where the embeddings at the ``k``-th of ``SIDES`` are."""
    return slice(k * WIDTH, (k + 1) * WIDTH)


@dataclass(frozen=True)
class Block:
    """Consecutive words of some texts.

    ``target``: their ids; ``ids``: the same with ``REACH`` words more on either side;
    ``outside``: for each of ``SIDES`` the words whose neighbour there is another text's;
    ``near``: for each of ``SIDES`` the rows of ``WIDTH`` columns that hold the neighbours'
    embeddings, counted from the end for what is outside.
    """

    ids: np.ndarray
    target: np.ndarray
    outside: list[np.ndarray]
    near: np.ndarray


@dataclass
class Network:
    """Parameters by name, all single precision."""

    parts: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Random small weights, and biases that give each id its frequency; as many ids as counts."""
        random = np.random.default_rng(5)
        shapes = _shapes(math.isqrt(len(counts)))
        parts = {k: (random.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes.items()}
        table = (counts + 1.0).reshape(shapes["word_bias"])
        parts["class_bias"] = np.log(table.sum(axis=1) / table.sum()).astype(np.float32)
        parts["word_bias"] = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
        parts["gate"] = np.ones(shapes["gate"], dtype=np.float32)
        parts["bias"] = np.zeros(shapes["bias"], dtype=np.float32)
        return cls(parts)

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Network:
        parts, at = {}, 0
        # Nearly all are embeddings and word biases; the rest is less than one more class would add.
        side = math.isqrt(len(flat) // (len(SIDES) * WIDTH + 1))
        for name, shape in _shapes(side).items():
            size = int(np.prod(shape))
            parts[name] = flat[at : at + size].reshape(shape).astype(np.float32)
            at += size
        return cls(parts)

    def pack(self) -> np.ndarray:
        return np.concatenate([part.ravel() for part in self.parts.values()])

    def forward(self, block: Block):
        """Log probabilities of the block's words, and what the gradient needs."""
        p, target = self.parts, block.target
        near = p["embedding"].reshape(-1, WIDTH).take(block.near, axis=0)
        hidden = near[0] + p["bias"]
        for k in range(1, len(SIDES)):
            hidden += near[k]
        np.tanh(hidden, out=hidden)
        side = len(p["class_bias"])
        group, member = np.divmod(target, side)
        gate = p["gate"].take(group, axis=0)
        row, ones = np.arange(0, side * len(target), side), np.ones(side, dtype=np.float32)
        first = hidden @ p["classes"]
        first += p["class_bias"]
        gated = hidden * gate
        second = gated @ p["words"]
        second += p["word_bias"].take(group, axis=0)
        log_p = np.zeros(len(target))
        weights = []
        for logits, chosen in ((first, row + group), (second, row + member)):
            if logits.max(initial=0) > 60:
                np.minimum(logits, 60, out=logits)  # exp of it stays finite, sums too
            at = logits.ravel().take(chosen)
            np.exp(logits, out=logits)
            total = logits @ ones
            log_p += at - np.log(total)
            weights.append((logits, total, chosen))
        return log_p, (hidden, gate, gated, group, *weights)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and where each begins."""
    new = np.empty(len(ordered), dtype=bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    begins = np.flatnonzero(new)
    return ordered[begins], begins


def _order(values: np.ndarray, below: int) -> np.ndarray:
    """Where the values, all in ``range(below)``, are in rising order; equal ones as they come."""
    return np.argsort(values.astype(np.uint16) if below <= 1 << 16 else values, kind="stable")


def _sums(rows: np.ndarray, order: np.ndarray, begins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums of the rows in ``order`` from each of ``begins`` to the next.

    Rows by themselves are only copied, ``MANY`` or more are summed by a product. Groups in
    between are padded to one size, so that one stack of products sums them all.
    """
    counts = np.append(begins[1:], len(order)) - begins
    first = order.take(begins)
    out = rows.take(first, axis=0)
    out *= weights.take(first)[:, None]
    several = np.flatnonzero((counts > 1) & (counts < MANY))
    if len(several):
        step = np.arange(MANY - 1)
        there = step < counts.take(several)[:, None]
        at = order.take(begins.take(several)[:, None] + step * there)  # padding: the group's first row, weighted by 0
        out[several] = np.matmul((weights.take(at) * there)[:, None], rows.take(at, axis=0))[:, 0]
    many = np.flatnonzero(counts >= MANY)
    for k, begin, count in zip(many.tolist(), begins.take(many).tolist(), counts.take(many).tolist(), strict=True):
        at = order[begin : begin + count]
        out[k] = weights.take(at) @ rows.take(at, axis=0)
    return out


@lru_cache(maxsize=4)
def _neighbour_of(n: int) -> np.ndarray:
    """Of ``n`` words with ``REACH`` more on either side: for each and each of ``SIDES`` the word that has it there, else ``n``."""
    out = np.arange(n + 2 * REACH)[:, None] - REACH - np.array(SIDES)
    return np.where((out >= 0) & (out < n), out, n)


class Trainer:
    """Adagrad on mini-batches; sums of squares start anew with every task."""

    def __init__(self, network: Network, rate: float = RATE):
        self.network, self.rate = network, rate
        self._squares = {k: np.full(v.shape, 1e-3, dtype=np.float32) for k, v in network.parts.items()}

    def _step(self, name: str, gradient: np.ndarray, rows=slice(None)) -> None:
        squares = self._squares[name][rows]
        squares += gradient * gradient
        self._squares[name][rows] = squares
        change = self.rate * gradient
        change /= np.sqrt(squares)
        self.network.parts[name][rows] -= change

    def learn(self, block: Block) -> float:
        """One step; the mean log probability before it."""
        p, n = self.network.parts, np.float32(len(block.target))
        log_p, (hidden, gate, gated, group, *weights) = self.network.forward(block)
        (first, first_total, first_chosen), (second, second_total, second_chosen) = weights
        # The wide rows stay as they are; their scales go to the narrow ones they are multiplied with.
        first_scale, second_scale = 1 / (n * first_total), 1 / (n * second_total)
        first.reshape(-1)[first_chosen] -= first_total
        second.reshape(-1)[second_chosen] -= second_total
        to_gated = second @ p["words"].T
        to_gated *= second_scale[:, None]
        # One more row of zeros is for what is no word's neighbour.
        to_words = np.zeros((len(group) + 1, WIDTH), dtype=np.float32)
        to_hidden = np.matmul(first, p["classes"].T, out=to_words[:-1])
        to_hidden *= first_scale[:, None]
        to_hidden += to_gated * gate
        to_hidden *= 1 - hidden * hidden
        order = _order(group, len(p["gate"]))
        groups, begins = _runs(group[order])
        ones = np.ones(len(block.ids), dtype=np.float32)
        self._step("classes", (first.T @ (hidden * first_scale[:, None])).T)
        self._step("class_bias", first_scale @ first)
        self._step("words", (second.T @ (gated * second_scale[:, None])).T)
        self._step("gate", np.add.reduceat((to_gated * hidden).take(order, axis=0), begins, axis=0), groups)
        self._step("word_bias", _sums(second, order, begins, second_scale), groups)
        self._step("bias", ones[: len(group)] @ to_hidden)
        of = _neighbour_of(len(group)).copy()
        for k, (side, rows_out) in enumerate(zip(SIDES, block.outside, strict=True)):
            of[REACH + side + rows_out, k] = len(group)
        to_near = to_words.take(of, axis=0).reshape(len(block.ids), -1)
        order = _order(block.ids, len(p["embedding"]))
        ids, begins = _runs(block.ids[order])
        beyond = [to_hidden.take(rows_out, axis=0).sum(axis=0) for rows_out in block.outside]
        sums = np.concatenate([_sums(to_near, order, begins, ones), np.concatenate(beyond)[None]])
        self._step("embedding", sums, np.append(ids, len(p["embedding"]) - 1))
        return float(log_p.mean())


@dataclass(frozen=True)
class Vocabulary:
    """Hashes of the ``KNOWN`` most frequent words in order, their ids and log shares of them.

    ``counts``: how often each id occurs; ``path``: the written counts of all words.
    ``least``: no word that is not known occurs more often.
    """

    hashes: np.ndarray
    ids: np.ndarray
    shares: np.ndarray
    counts: np.ndarray
    path: str
    least: int

    @cached_property
    def _begins(self) -> np.ndarray:
        """Where the hashes begin that have each value of the leading bits."""
        leading = np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS)
        return np.searchsorted(self.hashes, leading).astype(np.int32)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each is among the known ones, or the next greater or the last is if it isn't."""
        last = len(self.hashes) - 1
        at = np.minimum(self._begins.take(hashes >> np.uint64(64 - BITS)), last)
        left = np.flatnonzero(self.hashes.take(at) < hashes)
        for _ in range(STEPS):
            left = left[at[left] < last]
            at[left] += 1
            left = left[self.hashes.take(at[left]) < hashes[left]]
            if not len(left):
                return at
        at[left] = np.minimum(np.searchsorted(self.hashes, hashes[left]), last)
        return at

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, log shares of them, and which words are known.

        Of an unknown word the share lacks the log of its count.
        """
        side = math.isqrt(len(self.counts))
        if len(self.hashes):
            at = self._places(hashes)
            out, shares, known = self.ids.take(at), self.shares.take(at), self.hashes.take(at) == hashes
        else:
            out, shares, known = (np.zeros(len(hashes), dtype=t) for t in (np.int32, np.float64, bool))
        unknown = np.flatnonzero(~known)
        out[unknown] = len(self.counts) - side + (hashes[unknown] % np.uint64(side)).astype(np.int64)
        shares[unknown] = -np.log(self.counts[out[unknown]] + 1)
        return out, shares, known


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = lower(data)
    found = words(data, offsets)
    return SpanHashes(data).of(found.starts, found.ends), found.first


def blocks(ids: np.ndarray, first: np.ndarray, size: int) -> Iterator[Block]:
    """The words of a slice in text order, ``size`` at a time, each with its neighbours."""
    padded = np.pad(ids, REACH).astype(np.int32)  # what is put there is outside of every text
    begin, end = first[:-1], first[1:]
    edges = np.arange(0, len(ids) + size, size)
    beyond = []
    for side in SIDES:
        ends = [begin + k if side < 0 else end - 1 - k for k in range(abs(side))]
        beyond.append(np.unique(np.concatenate([x[(x >= begin) & (x < end)] for x in ends])))
    cuts = [np.searchsorted(x, edges) for x in beyond]
    near = np.empty((len(SIDES), len(ids)), dtype=np.int32)
    for k, (side, rows_out) in enumerate(zip(SIDES, beyond, strict=True)):
        np.multiply(padded[REACH + side : REACH + side + len(ids)], len(SIDES), out=near[k])
        near[k, rows_out] = -len(SIDES)
        near[k] += k
    for number, k in enumerate(range(0, len(ids), size)):
        n = min(size, len(ids) - k)
        outside = [x[cut[number] : cut[number + 1]] - k for x, cut in zip(beyond, cuts, strict=True)]
        yield Block(padded[k : k + n + 2 * REACH], padded[k + REACH : k + REACH + n], outside, near[:, k : k + n])


_MERGE_AT = 500_000


def learn_vocabulary(spark: SparkSession, docs: DataFrame, text: str = "text") -> Vocabulary:
    """Counts of all words of all texts, written; the most frequent come to the driver.

    Of each bucket one occurrence more is kept for words the corpus doesn't have.
    """
    narrow = docs.select(col(text).alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            hashes, group = np.unique(np.concatenate([h for h, _ in pending]), return_inverse=True)
            sums = np.bincount(group, weights=np.concatenate([n for _, n in pending]))
            return hashes, sums.astype(np.int64)

        def batch_of(hashes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(sums)], names=["word", "n"])

        for batch in batches:
            for part in by_bytes(batch, "body"):
                pending.append(np.unique(_word_hashes(part.column("body"))[0], return_counts=True))
                if sum(len(h) for h, _ in pending) > 2 * _MERGE_AT:
                    pending = [merged()]
                    if len(pending[0][0]) > _MERGE_AT:  # a task never holds more than this
                        yield batch_of(*pending.pop())
        if pending:
            yield batch_of(*merged())

    path = run_dir(spark, "word-counts")
    narrow.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(path)
    counted = spark.read.parquet(path)
    distinct = counted.count()
    side = side_of(distinct)
    own = side * side - side
    top, _ = _most_frequent(counted, max(KNOWN, own))
    hashes = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], dtype=np.float64)
    ids = np.arange(len(top), dtype=np.int64)
    ids[own:] = own + (hashes[own:] % np.uint64(side)).astype(np.int64)
    counts = np.zeros(side * side)
    counts[: min(own, len(top))] = n[:own]
    unsigned = F.pmod("word", F.lit(side)) + F.when(F.col("word") < 0, F.lit(2**64 % side)).otherwise(F.lit(0))
    for row in counted.groupBy(F.pmod(unsigned, F.lit(side)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        counts[own + row["bucket"]] = row["n"]
    np.subtract.at(counts, own + (hashes[:own] % np.uint64(side)).astype(np.int64), n[:own])
    shares = np.where(np.arange(len(top)) < own, 0.0, np.log(n) - np.log(counts[ids] + 1))
    order = np.argsort(hashes)
    least = int(n[-1]) if len(top) else 0
    return Vocabulary(hashes[order], ids[order].astype(np.int32), shares[order], counts, path, least)


def _most_frequent(counted: DataFrame, most: int) -> tuple[list, int]:
    """The ``most`` rows of the greatest n, equal ones by word, and the sum of n.

    A histogram over steps of n tells in which step the last of them lies. All rows above
    it come to the driver, fewer than ``most``; only its own rows are put in order.
    """
    step = F.floor(F.log2("n") * 16)
    histogram = counted.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    last, above = None, 0
    for row in sorted(histogram, key=lambda r: -r["step"]):
        if above + row["words"] > most:
            last = row["step"]
            break
        above += row["words"]
    if last is None:
        top = counted.collect()  # no more rows than wanted
    else:
        order = [F.desc("n"), F.asc("word")]
        rest = counted.where(step == F.lit(last)).orderBy(*order).limit(most - above)
        top = counted.where(step > F.lit(last)).collect() + (rest.collect() if above < most else [])
    return sorted(top, key=lambda r: (-r["n"], r["word"])), sum(r["n"] for r in histogram)


@dataclass(frozen=True)
class Encoded:
    """Written texts as ids: one row each, read by all rounds and by scoring.

    Columns under names that none of ``kept`` has: the text's number, its round (null where
    the text is), its ids as bytes, the sum of its words' known log shares, and the hashes of
    the words whose counts the tasks don't know.
    """

    frame: DataFrame
    kept: list[str]
    names: tuple[str, str, str, str, str]


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    keep: tuple[str, ...] = (),
    rounds: int = ROUNDS,
) -> Encoded:
    """Cut and look up all words of all texts once."""
    spark = docs.sparkSession
    frame, kept, body, schema = narrowed(docs, keep, text, "n_words long, log_likelihood double, mean_log_likelihood double")
    row, turn, ids_, shares_, rest = free_names(schema.names, "row", "round", "ids", "shares", "rest")
    frame = frame.withColumn(turn, F.pmod(F.xxhash64(col(body)), F.lit(rounds)).cast("int"))
    fields = T.StructType.fromDDL("row long, round int, ids binary, shares double, rest array<bigint>").fields
    named = [T.StructField(n, f.dataType) for n, f in zip((row, turn, ids_, shares_, rest), fields, strict=True)]
    written = T.StructType([*schema.fields[: len(kept)], *named])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in by_bytes(batch, body):
                hashes, first = _word_hashes(part.column(body))
                ids, shares, known = vocabulary.lookup(hashes)
                sums = np.concatenate(([0.0], np.cumsum(shares)))
                unknown = np.flatnonzero(~known)
                words_left = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(unknown, first), type=pa.int32()), pa.array(hashes[unknown].view(np.int64))
                )
                n = part.num_rows
                packed = pa.Array.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer((first * 4).astype(np.int64)), pa.py_buffer(ids.astype(np.int32))]
                )
                columns = [
                    pa.array(number + np.arange(n, dtype=np.int64)),
                    part.column(turn),
                    packed.cast(pa.binary()),
                    pa.array(sums[first[1:]] - sums[first[:-1]]),
                    words_left,
                ]
                number += n
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=written.names)

    path = run_dir(spark, "word-ids")
    frame.mapInArrow(run, written).write.parquet(path)
    return Encoded(spark.read.schema(written).parquet(path), kept, (row, turn, ids_, shares_, rest))


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts one after the other, and where each text begins."""
    data, offsets = text_bytes(column)
    return data.view(np.int32), offsets // 4


def train(
    spark: SparkSession, docs: DataFrame, text: str = "text", rounds: int = ROUNDS
) -> tuple[Vocabulary, Network]:
    """Vocabulary and network learned from all texts; see ``fit``."""
    vocabulary = learn_vocabulary(spark, docs, text)
    return vocabulary, fit(spark, encode(docs, vocabulary, text, rounds=rounds), vocabulary, rounds)


def learners(spark: SparkSession) -> int:
    """How many tasks learn at once: as many as there are cores, however many files there are.

    Each sends a whole model in each round, so their number must not grow with the corpus.
    """
    return max(1, spark.sparkContext.defaultParallelism)


def fit(spark: SparkSession, encoded: Encoded, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """The network learned from all texts.

    A text belongs to one round by its hash, so each is learned from once. Without any
    words the network stays as it begins. The result depends, in small measure, on how the
    files are dealt out to the learners.
    """
    network = Network.fresh(vocabulary.counts)
    _, turn, ids_, _, _ = encoded.names
    narrow = encoded.frame.where(F.length(col(ids_)) > 0)

    def learn(start: np.ndarray, number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            random = np.random.default_rng(number)
            trainer, seen = Trainer(Network.unpack(start)), 0
            for batch in batches:
                for part in by_bytes(batch, "ids"):
                    ids, first = _ids_of(part.column("ids"))
                    steps = list(blocks(ids, first, BATCH))
                    for k in random.permutation(len(steps)):
                        trainer.learn(steps[k])
                    seen += len(ids)
            if seen:
                flat = trainer.network.pack()
                pieces = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(len(pieces)), type=pa.int32()),
                        pa.array([float(seen)] * len(pieces)),
                        pa.array(pieces, type=pa.binary()),
                    ],
                    names=["block", "weight", "values"],
                )

        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[float, np.ndarray]] = {}  # at most a model's blocks, however many rows
        for batch in batches:
            for block, weight, values in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                part = weight * np.frombuffer(values, dtype=np.float32).astype(np.float64)
                if block in sums:
                    sums[block] = (sums[block][0] + weight, sums[block][1] + part)
                else:
                    sums[block] = (weight, part)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), type=pa.int32()),
                    pa.array([(s / w).astype(np.float32).tobytes() for w, s in sums.values()], type=pa.binary()),
                ],
                names=["block", "values"],
            )

    for number in range(rounds):
        part = narrow.where(col(turn) == number).select(col(ids_).alias("ids")).coalesce(learners(spark))
        models = part.mapInArrow(learn(network.pack(), number), "block int, weight double, values binary")
        rows = models.repartition("block").mapInArrow(average, "block int, values binary").collect()
        if rows:
            flat = np.concatenate(
                [np.frombuffer(bytes(r["values"]), dtype=np.float32) for r in sorted(rows, key=lambda r: r["block"])]
            )
            network = Network.unpack(flat)
    return network


def score(
    docs: DataFrame, vocabulary: Vocabulary, network: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Kept columns, n_words, ``log_likelihood`` (summed over the words) and ``mean_log_likelihood``.

    Whole texts are scored. A null or empty text has no words, the sum 0 and no mean.
    """
    return score_encoded(encode(docs, vocabulary, text, keep), vocabulary, network)


def score_encoded(encoded: Encoded, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """The same from ids. What the tasks can tell is written; counts of words they don't know are joined to it."""
    frame, kept = encoded.frame, encoded.kept
    spark = frame.sparkSession
    row, _, ids_, shares_, rest = encoded.names
    of, added, total_ = free_names([*frame.columns, "n_words", "log_likelihood", "mean_log_likelihood"], "of", "added", "total")
    fields = [f for f in frame.schema if f.name in (*kept, row, rest)]
    partial = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField(total_, T.DoubleType())])
    passed = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, ids_):
                ids, first = _ids_of(part.column(ids_))
                log_p = [network.forward(b)[0] for b in blocks(ids, first, SCORED)]
                sums = np.concatenate([[0.0], np.cumsum(np.concatenate(log_p or [np.zeros(0)]))])
                total = sums[first[1:]] - sums[first[:-1]] + np.asarray(part.column(shares_))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in passed), pa.array(np.diff(first).astype(np.int64)), pa.array(total)],
                    names=partial.names,
                )

    path = run_dir(spark, "word-scores")
    frame.mapInArrow(run, partial).write.parquet(path)
    scored = spark.read.schema(partial).parquet(path)
    counted = spark.read.parquet(vocabulary.path).where(F.col("n") <= vocabulary.least)
    left = scored.select(col(row).alias(of), F.explode(col(rest)).alias("left"))
    logs = (
        left.join(counted, F.col("left") == F.col("word"), "left")
        .groupBy(col(of))
        .agg(F.sum(F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))).alias(added))
    )
    total = col(total_) + F.coalesce(col(added), F.lit(0.0))
    return scored.join(logs, col(row) == col(of), "left").select(
        *map(col, kept),
        "n_words",
        total.alias("log_likelihood"),
        F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"),
    )


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vocabulary = learn_vocabulary(spark, docs)
    encoded = encode(docs, vocabulary, keep=("doc_id",))
    return score_encoded(encoded, vocabulary, fit(spark, encoded, vocabulary))
