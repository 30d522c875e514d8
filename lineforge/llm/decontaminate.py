"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by the size n of their shingle sets, a class for each power of two.
Each class is searched on its own, with its own filters. An item's signature is a bottom-k
MinHash: the k smallest hashes of its shingles, with k = n - ceil(t n) + 1 for the wanted
containment t. A document that holds t of the shingles lacks at most n - ceil(t n) of them
and so holds one of the k: the search misses nothing, whatever the document's length, and
a document smaller than the least ceil(t n) of a class is no candidate in it. Candidates are verified by counting
how many of the item's shingles the whole document has.

An item of fewer words than a shingle has is a class with those of its length: documents'
runs of so many words are then looked up, too, so short items are found inside long texts.
Shingles go with their words, and the joins compare these, so containment is exact.

Documents are read once. For each class a filter of fixed size over the signatures' hashes
decides in the tasks which documents can be candidates, and one over all its items' hashes
which of their shingles matter; the joins that follow settle what the filters leave open. A
benchmark too large for the filters only makes more rows pass them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.llm.arrow import SpanHashes, Words, by_bytes, lower, shingle_hashes, text_bytes, words
from lineforge.llm.names import col, free_names
from lineforge.session import run_dir

SHINGLE = 5
CONTAINMENT = 0.8
# Each filter is a bitmap of 2**21 bits, 256 KB, whatever the benchmark's size. A class is a
# number of bits of an item's size, so there are two filters for each of some twenty at most.
FILTER_BITS = 21


def needed(n: int, containment: float) -> int:
    """Shingles of an item of ``n`` that a document must have; exact for containments in thousandths."""
    return -(-n * round(containment * 1000) // 1000)


@dataclass(frozen=True)
class Shingles:
    """Shingles of some texts: hashes, rows, the number of each one's first word; and the words themselves."""

    data: np.ndarray
    found: Words
    word: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Shingles:
        data, offsets = text_bytes(column)
        data = lower(data)
        found = words(data, offsets)
        return cls(data, found, SpanHashes(data).of(found.starts, found.ends))

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row and first word of each run of ``size`` words, or of a shorter text's whole sequence."""
        hashes, row = shingle_hashes(self.word, self.found.first, size)
        counts = np.diff(self.found.first)
        n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.found.first[:-1][row]
        return hashes, row, at

    def texts(self, at: np.ndarray, row: np.ndarray, size: int) -> list[bytes]:
        """The words of runs that begin there, joined by one space."""
        starts, ends, last = self.found.starts, self.found.ends, self.found.first[1:]
        return [
            b" ".join(self.data[starts[w] : ends[w]].tobytes() for w in range(a, min(a + size, last[r])))
            for a, r in zip(at, row, strict=True)
        ]


def signatures(
    items: DataFrame, text: str, key: str, size: int = SHINGLE, containment: float = CONTAINMENT
) -> DataFrame:
    """(item, item_row, n, need, size_class, hash, words, signed): the distinct shingles of each item.

    ``signed`` marks those of the bottom-k signature. The class is the number of bits of n,
    or for items of fewer than ``size`` words the number of words below zero. Items
    without words have no rows; ``item_row`` tells rows that repeat an id apart.
    """
    narrow = items.select(col(key).alias("item"), F.monotonically_increasing_id().alias("item_row"), col(text).alias("body"))
    kind = narrow.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "body"):
                shingles = Shingles.of(part.column("body"))
                hashes, row, at = shingles.runs(size)
                texts = shingles.texts(at, row, size)
                counts, ends = np.diff(shingles.found.first), np.searchsorted(row, np.arange(part.num_rows + 1))
                for r in np.unique(row):
                    own = sorted({(int(hashes[k]), texts[k]) for k in range(ends[r], ends[r + 1])})
                    n, need = len(own), needed(len(own), containment)
                    size_class = n.bit_length() if counts[r] >= size else -int(counts[r])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("item").take(pa.array(np.full(n, r))),
                            part.column("item_row").take(pa.array(np.full(n, r))),
                            pa.array(np.full(n, n), type=pa.int64()),
                            pa.array(np.full(n, need), type=pa.int64()),
                            pa.array(np.full(n, size_class), type=pa.int32()),
                            pa.array(np.array([h for h, _ in own], dtype=np.uint64).view(np.int64)),
                            pa.array([t for _, t in own], type=pa.binary()),
                            pa.array(np.arange(n) < n - need + 1),
                        ],
                        names=["item", "item_row", "n", "need", "size_class", "hash", "words", "signed"],
                    )

    return narrow.mapInArrow(
        run,
        f"item {kind}, item_row long, n long, need long, size_class int, hash long, words binary, signed boolean",
    )


@dataclass(frozen=True)
class ClassFilter:
    """What a task knows of one size class: least shingles, bitmaps of signatures and of all."""

    size_class: int
    least: int
    signed: np.ndarray
    every: np.ndarray


def _filters(signed: DataFrame) -> list[ClassFilter]:
    """The classes' filters, put together from pieces of 4 KB that aggregates make."""
    place = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    spot = place.bitwiseAND(F.lit(0x7FFF))
    rows = (
        signed.groupBy("size_class", F.shiftrightunsigned(place, 15).alias("piece"))
        .agg(
            F.min("need").alias("least"),
            F.bitmap_construct_agg(spot).alias("every"),
            F.bitmap_construct_agg(F.when(F.col("signed"), spot)).alias("signed"),
        )
        .collect()
    )
    out = {}
    for row in rows:
        size_class = row["size_class"]
        if size_class not in out:
            empty = [np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8) for _ in range(2)]
            out[size_class] = ClassFilter(size_class, row["least"], *empty)
        known = out[size_class]
        for name in ("signed", "every"):
            bits = np.frombuffer(bytes(row[name]), dtype=np.uint8)
            getattr(known, name)[row["piece"] * 4096 : row["piece"] * 4096 + len(bits)] = bits
        out[size_class] = replace(known, least=min(known.least, row["least"]))
    return [out[c] for c in sorted(out)]


def _test(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7)) & 1 == 1


def contained(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    size: int = SHINGLE,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Pairs (key, item_key, n_shared, n_shingles) with n_shared / n_shingles >= ``containment``.

    Words are runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased;
    shingles are sets of five consecutive words. An item of fewer words is one shingle, and
    is found in every document that has these words in a row. Items and documents without
    words, null texts included, match nothing, nor do null ids. Rows that repeat an id are
    texts of their own: a pair is found if a row of the one holds a row of the other, with
    the figures of the pair of rows that shares most, then of the shortest item. Shingles are
    equal where their bytes are.
    """
    path = run_dir(spark, "benchmark-signatures")
    signatures(items.where(col(item_key).isNotNull()), item_text, item_key, size, containment).write.parquet(path)
    signed = spark.read.parquet(path)
    filters = spark.sparkContext.broadcast(_filters(signed))

    narrow = docs.where(col(key).isNotNull()).select(
        col(key).alias("doc"), F.monotonically_increasing_id().alias("doc_row"), col(text).alias("body")
    )
    kind = narrow.schema["doc"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "body"):
                shingles = Shingles.of(part.column("body"))
                runs = {}
                for known in filters.value:
                    length = min(size, -known.size_class) if known.size_class < 0 else size
                    if length not in runs:
                        runs[length] = shingles.runs(length)
                    hashes, row, at = runs[length]
                    counts = np.bincount(row, minlength=part.num_rows)
                    possible = np.zeros(part.num_rows, dtype=bool)
                    possible[row[_test(known.signed, hashes)]] = True
                    possible &= counts >= known.least
                    chosen = np.flatnonzero(possible[row])
                    chosen = chosen[_test(known.every, hashes[chosen])]
                    if len(chosen):
                        rows = pa.array(row[chosen])
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("doc").take(rows),
                                part.column("doc_row").take(rows),
                                pa.array(np.full(len(chosen), known.size_class, dtype=np.int32)),
                                pa.array(hashes[chosen].view(np.int64)),
                                pa.array(shingles.texts(at[chosen], row[chosen], length), type=pa.binary()),
                            ],
                            names=["doc", "doc_row", "of_class", "shingle", "held"],
                        )

    probed = narrow.mapInArrow(probe, f"doc {kind}, doc_row long, of_class int, shingle long, held binary")
    hits = probed.join(
        signed,
        (probed["shingle"] == signed["hash"])
        & (probed["of_class"] == signed["size_class"])
        & (probed["held"] == signed["words"]),
    )
    rows = (
        hits.groupBy("doc", "item", "doc_row", "item_row", "n", "need")
        .agg(F.countDistinct("words").alias("n_shared"), F.max("signed").alias("candidate"))
        .where(F.col("candidate") & (F.col("n_shared") >= F.col("need")))
    )
    best = F.max(F.struct(F.col("n_shared"), (-F.col("n")).alias("less"))).alias("best")
    doc, item = free_names(["n_shared", "n_shingles"], key, item_key)
    return (
        rows.groupBy("doc", "item")
        .agg(best)
        .select(
            F.col("doc").alias(doc),
            F.col("item").alias(item),
            F.col("best.n_shared").alias("n_shared"),
            (-F.col("best.less")).alias("n_shingles"),
        )
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(
        spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; null ids stay.

    Of rows that repeat an id all go if one holds an item.
    """
    found = contained(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.select(F.col("doc_id").alias("leak")).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks["leak"], "left_anti")


OP2_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id AS id, false AS item, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT -row_number() OVER (), item_id, true, text FROM benchmark WHERE item_id IS NOT NULL
), split AS (
  SELECT r, id, item, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM texts
), sizes AS (
  SELECT DISTINCT least(5, len(ws)) AS k FROM split WHERE item AND len(ws) > 0
), shingles AS (
  SELECT DISTINCT r, id, item, k, array_to_string(ws[i:i+k-1], ' ') AS s
  FROM (SELECT r, id, item, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM split, sizes
        WHERE len(ws) >= k AND (NOT item OR k = least(5, len(ws))))
), totals AS (
  SELECT r, count(*) AS n FROM shingles WHERE item GROUP BY r
), pairs AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n) AS n_shingles
  FROM shingles d JOIN shingles b ON d.s = b.s AND d.k = b.k AND b.item AND NOT d.item JOIN totals ON totals.r = b.r
  GROUP BY d.r, d.id, b.r, b.id HAVING count(*) * 10 >= any_value(n) * 8
)
SELECT doc_id, item_id, max(n_shared) AS n_shared, arg_max(n_shingles, n_shared * 1000000000 - n_shingles) AS n_shingles
FROM pairs GROUP BY doc_id, item_id
"""
