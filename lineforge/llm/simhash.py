"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect binary Golay code (23, 12, 7). A word within two bits of a codeword has that
codeword's index as its one key; at three bits it also has the five codewords at four bits.
Two words that differ in one bit then have the nearest codeword of each among the keys of
the other.

If two fingerprints differ in at most three bits, either one segment agrees exactly and
another differs in at most one bit, or each segment differs in exactly one. So nine bit
fields, joined with equality, find every such pair: for each ordered pair of segments the
bits of the one with a key of the other, and once the keys of all three. One side of the
join carries all keys of a segment, the other only the nearest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.llm.arrow import by_bytes, lower, text_bytes, words
from lineforge.llm.components import components, split_join
from lineforge.llm.names import col, free_names, narrowed
from lineforge.session import run_dir

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
_BLOCK = 1 << 15  # shingles unpacked to bits at once

# Generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words divided by the generator polynomial."""
    word = word.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        word ^= np.where(word >> bit & 1, _GENERATOR << (bit - 11), 0).astype(np.uint32)
    return word


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: how many keys a word has, and the index bits that lead to each; the nearest comes first.

    Also the syndromes of all words of 23 bits whose upper bits are zero in 12 and 11 bits.
    """
    patterns = [sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(23), w)]
    patterns = np.array(patterns, dtype=np.uint32)
    syndromes = _syndrome(patterns)
    weights = np.array([int(p).bit_count() for p in patterns])
    count = np.zeros(2048, dtype=np.int64)
    turn = np.zeros((2048, 6), dtype=np.uint32)
    for pattern, syndrome, weight in zip(patterns, syndromes, weights, strict=True):
        if weight < 4 or int(count[syndrome]) >= 1 and _far(turn, count, syndrome, weight):
            turn[syndrome, count[syndrome]] = pattern
            count[syndrome] += 1
    return count, turn, _syndrome(np.arange(1 << 12, dtype=np.uint32) << 11)


def _far(turn: np.ndarray, count: np.ndarray, syndrome: int, weight: int) -> bool:
    """Whether the word lies three bits from its codeword, so that those at four bits count."""
    return weight == 4 and int(turn[syndrome, 0]).bit_count() == 3


def golay_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of keys of each word, and its keys, the nearest codeword's index first."""
    count, turn, upper = _tables()
    word = word.astype(np.uint32)
    syndrome = upper[word >> 11] ^ (word & 0x7FF)
    return count[syndrome], (word[:, None] ^ turn[syndrome]) >> 11


def fingerprints(column: pa.Array) -> np.ndarray:
    """SimHash of each whole text as unsigned 64-bit integers; zero without words."""
    import xxhash

    data, offsets = text_bytes(column)
    data = lower(data)
    found = words(data, offsets)
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    if not len(found.starts):
        return out
    # Words side by side with one space after each, so that a shingle is a slice.
    sizes = found.ends - found.starts
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int(begins[-1] + sizes[-1] + 1), 0x20, dtype=np.uint8)
    shift = np.repeat(begins - found.starts, sizes)
    at = np.arange(len(shift)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(found.starts, sizes)
    joined[at + shift] = data[at]
    text = joined.tobytes()
    stops = begins + sizes
    digest = xxhash.xxh64_intdigest
    for row in np.flatnonzero(np.diff(found.first)):
        first, last = found.first[row], found.first[row + 1]
        size = min(SHINGLE, last - first)
        left, right = begins[first : last - size + 1], stops[first + size - 1 : last]
        ones = np.zeros(64, dtype=np.int64)
        for k in range(0, len(left), _BLOCK):
            spans = zip(left[k : k + _BLOCK].tolist(), right[k : k + _BLOCK].tolist(), strict=True)
            hashes = np.array([digest(text[a:b], SEED) for a, b in spans], dtype=np.uint64)
            bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
            ones += bits.sum(axis=0, dtype=np.int32)
        out[row] = np.packbits(2 * ones > len(left), bitorder="little").view(np.uint64)[0]
    return out


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [
        (prints >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.uint32) for first, width in SEGMENTS
    ]


def join_keys(prints: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """For the two sides of the join: pairs of row numbers and keys, one pair for each bit field."""
    rows = np.arange(len(prints))
    exact = [s.astype(np.int64) for s in _segments(prints)]
    counts, keys = zip(*(golay_keys(s) for s in _segments(prints)), strict=True)
    keys = [k.astype(np.int64) for k in keys]
    many, few = [], []
    for field, (i, j) in enumerate(permutations(range(3), 2)):
        base = np.int64(field) << 40 | exact[i] << 12
        for k in range(6):
            some = rows[counts[j] > k]
            many.append((some, base[some] | keys[j][some, k]))
        few.append((rows, base | keys[j][:, 0]))
    for a in range(6):
        own = rows[counts[2] > a]
        few.append((own, np.int64(6) << 40 | keys[0][own, 0] << 24 | keys[1][own, 0] << 12 | keys[2][own, a]))
        for b in range(6):
            own = rows[(counts[0] > a) & (counts[1] > b)]
            many.append((own, np.int64(6) << 40 | keys[0][own, a] << 24 | keys[1][own, b] << 12 | keys[2][own, 0]))
    return many, few


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and ``print``, the fingerprint's 64 bits as a signed number."""
    narrow, kept, body, schema = narrowed(docs, keep, text, "print long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, body):
                prints = pa.array(fingerprints(part.column(body)).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), prints], names=schema.names)

    return narrow.mapInArrow(run, schema)


def links(prints: DataFrame, column: str = "print") -> DataFrame:
    """Pairs (a < b) of different fingerprints at up to three bits; each may come several times.

    A fingerprint has some 60 keys on one side and 11 on the other. A bucket holds only
    fingerprints that agree in at least one segment's 21 bits and are close in another, or
    are close in all three; the distance is tested inside the join, so what it puts out is
    links alone. No fingerprint has more than 43,744 others within three bits.
    """
    distinct = prints.select(F.col(column).alias("print")).where(F.col(column).isNotNull()).distinct()

    def side(number: int, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 8192):
                    own = np.asarray(batch.column(0).slice(first, 8192)).view(np.uint64)
                    for rows, keys in join_keys(own)[number]:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys), pa.array(own[rows].view(np.int64))], names=["key", name]
                        )

        return distinct.mapInArrow(run, f"key long, {name} long")

    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    many, few = side(0, "a"), side(1, "b")
    return many.join(few, (many["key"] == few["key"]) & (F.col("a") < F.col("b")) & close).select("a", "b")


def groups(spark: SparkSession, prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(print, component_id) for each fingerprint: the smallest id of those that links reach.

    Exact copies share a fingerprint, so they are counted as one before anything is
    joined. Null ids don't count; a component without any other has a null id.
    """
    path = run_dir(spark, "simhash-prints")
    prints.groupBy("print").agg(F.min(key).alias("first")).write.parquet(path)
    nodes = spark.read.parquet(path)
    roots = components(spark, links(nodes))
    placed = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    least = placed.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id"))
    return split_join(placed.select("print", "root"), "root", least, "_root").select("print", "component_id")


def hex_print(column: str = "print") -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: its key, ``fingerprint`` in 16 hex digits and component_id.

    Words are runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased;
    null and empty texts have none and the fingerprint zero, linked like any other.
    Repeated rows stay, each with the same component. An empty table gives no rows.
    """
    path = run_dir(spark, "simhash-documents")
    fingerprint(docs.select(col(key).alias("_key"), col(text).alias("_text")), "_text", ("_key",)).write.parquet(path)
    prints = spark.read.parquet(path)
    found = groups(spark, prints, "_key")
    joined = prints.join(found.withColumnRenamed("print", "_print"), F.col("print") == F.col("_print"))
    return joined.select(F.col("_key").alias(key), hex_print().alias("fingerprint"), "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays.

    It is the one with the smallest id, nulls last, then the smallest hash of its columns;
    of rows alike in all columns one stays.
    """
    path = run_dir(spark, "simhash-documents")
    (row,) = free_names(docs.columns, "row")
    hashed = docs.withColumn(row, F.xxhash64(*map(col, docs.columns)))
    slim = hashed.select(col("doc_id").alias("_id"), col(row).alias("_row"), col("text").alias("_text"))
    fingerprint(slim, "_text", ("_id", "_row")).write.parquet(path)
    prints = spark.read.parquet(path)
    found = groups(spark, prints, "_id").withColumnRenamed("print", "_print")
    # A component's rows never meet: their minimum is an aggregate over partial minima.
    placed = prints.join(found, F.col("print") == F.col("_print"))
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))).alias("first")
    nameless = F.when(F.col("component_id").isNull(), F.col("print")).alias("nameless")
    chosen = placed.groupBy("component_id", nameless).agg(first)
    winners = chosen.select(F.col("first._id").alias("_id"), F.col("first._row").alias("_row"))
    same = hashed["doc_id"].eqNullSafe(winners["_id"]) & (hashed[row] == winners["_row"])
    kept = hashed.join(winners, same, "left_semi").dropDuplicates(["doc_id", row])
    return kept.select(*map(col, docs.columns))
