"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last bytes says so, so equal passages
of different documents give equal chunks. A worker encodes each distinct chunk once and
keeps the ids of its core, the part between its first and its last safe cut; what lies
outside is known only together with its neighbours. A join of two chunks is repaired by
encoding the text around it anew, together with a guard piece of the core on either side;
the repair stands if the guards come out as they did inside the cores, and otherwise grows
until it does.

The memory of chunks is a worker's own and lives over its tasks: sending texts to where an
equal chunk was encoded would cost more than encoding it again.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lineforge.llm.arrow import by_bytes, mix, text_bytes
from lineforge.llm.names import narrowed
from lineforge.llm.tokens import BATCH_BYTES, Encoder, Memory, cuts, encoder

WINDOW = 32  # bytes under the rolling hash
AVERAGE = 1024  # a cut every so many bytes, a power of two
SMALLEST, LARGEST = 256, 8192
KNOWN_CHUNKS = 8_000  # in each of two generations

_VALUES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each byte (fewer at the start)."""
    total = _VALUES[data]
    power, width = _BASE, 1
    while width < WINDOW:  # doubling: a window of 2w bytes is two of w
        shifted = np.zeros_like(total)
        shifted[width:] = total[:-width]
        total = shifted * power + total
        power, width = power * power, width * 2
    return total


def chunks(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes, at boundaries of characters.

    A cut depends on the bytes before it and on the last cut alone, so after a passage's
    first cut the chunks of equal passages agree. Every byte belongs to one chunk.
    """
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    with np.errstate(over="ignore"):
        marked = mix(_rolling(data)) & np.uint64(AVERAGE - 1) == 0
    whole = np.ones(n, dtype=bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80  # the next byte begins a character
    places = np.flatnonzero(marked & whole) + 1
    ends, last = [], 0
    while n - last > SMALLEST:
        k = np.searchsorted(places, last + SMALLEST)
        end = int(places[k]) if k < len(places) else n
        if end - last > LARGEST:
            end = last + LARGEST
            while not whole[end - 1]:
                end -= 1
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


class ChunkEncoder:
    """Encodes texts by chunks that are encoded once."""

    def __init__(self, pieces: Encoder):
        self._pieces = pieces
        self._known = Memory(KNOWN_CHUNKS)
        self.encoded = 0  # chunks encoded so far, and those found in memory
        self.reused = 0

    def _learn(self, new: list[bytes]) -> None:
        """Split new chunks into head, guard, middle, guard and tail and encode the inner parts."""
        split, wanted = [], []
        for chunk in new:
            parts = cuts(chunk.decode())
            # The first part may continue the chunk before and the last one run on; a guard
            # on either side and a middle need five parts.
            if len(parts) < 5:
                self._known.put(chunk, ("".join(parts),))
            else:
                split.append((chunk, parts))
                wanted += [parts[1:2], parts[2:-2], parts[-2:-1]]
        ids = self._pieces.ids_of_parts(wanted)
        for k, (chunk, parts) in enumerate(split):
            left, middle, right = ids[3 * k : 3 * k + 3]
            self._known.put(chunk, (parts[0], parts[1], left, middle, parts[-2], right, parts[-1]))

    def ids(self, texts: list[tuple[bytes, list[int]]]) -> list[bytes]:
        """Ids of texts given as bytes and chunk ends."""
        pieces = [
            [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else [] for text, ends in texts
        ]
        distinct = {c for p in pieces for c in p}
        new = [c for c in distinct if self._known.get(c) is None]
        self.encoded += len(new)
        self.reused += sum(map(len, pieces)) - len(new)
        self._learn(new)
        known = {c: self._known.get(c) for c in distinct}
        lost = [c for c, v in known.items() if v is None]  # more chunks at once than memory holds
        for k in range(0, len(lost), KNOWN_CHUNKS):
            self._learn(lost[k : k + KNOWN_CHUNKS])
            known |= {c: self._known.get(c) for c in lost[k : k + KNOWN_CHUNKS]}

        # For each text: encoded middles, and between them joins to encode.
        plans, joins = [], []
        for own in pieces:
            plan, text, guard = [], "", b""
            for chunk in own:
                part = known[chunk]
                if len(part) == 1:
                    text += part[0]
                    continue
                head, left_text, left, middle, right_text, right, tail = part
                plan.append(((guard, text + head + left_text, left), middle))
                text, guard = right_text + tail, right
            plan.append(((guard, text, b""), b""))
            plans.append(plan)
            joins += [join[1] for join, _ in plan]
        found = self._pieces.ids(joins)
        out, k = [], 0
        for own, plan in zip(pieces, plans, strict=True):
            ids, agreed = [], True
            for (before, _, after), middle in plan:
                # Both guards must come out of the join as they did inside their chunks.
                agreed &= found[k].startswith(before) and found[k].endswith(after)
                ids += [found[k], middle]
                k += 1
            out.append(b"".join(ids) if agreed else self._whole(own))
        return out

    def _whole(self, own: list[bytes]) -> bytes:
        """The repair grown to the whole text."""
        return self._pieces.ids([b"".join(own).decode()])[0]


@functools.lru_cache(maxsize=2)
def chunk_encoder(vocabulary: str) -> ChunkEncoder:
    """A worker's encoder, kept between its tasks."""
    return ChunkEncoder(encoder(vocabulary))


def _encode(column: pa.Array, vocabulary: str) -> list[bytes]:
    data, offsets = text_bytes(column)
    spans = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return chunk_encoder(vocabulary).ids([(s.tobytes(), chunks(s)) for s in spans])


def _reversible(column: pa.Array, vocabulary: str) -> list[bytes]:
    """The texts' ids, of which each must give its text again; a null text is an empty one."""
    ids = _encode(column, vocabulary)
    decoded = encoder(vocabulary).decode(ids)
    wrong = sum(a != (b or "") for a, b in zip(decoded, column.to_pylist(), strict=True))
    if wrong:
        raise ValueError(f"{wrong} of {len(ids)} texts differ from what their ids decode to")
    return ids


def _through(docs: DataFrame, read: str, keep: tuple[str, ...], results: str, values) -> DataFrame:
    narrow, kept, body, schema = narrowed(docs, keep, read, results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, body, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), *values(part.column(body))], names=schema.names
                )

    return narrow.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, ``ids`` and ``n_tokens`` of each whole text.

    ``ids`` is binary: little-endian unsigned 32-bit integers, as the tokenizers library
    gives them without added special tokens, truncation or padding. A null text counts as
    empty and has none. Rows that repeat stay; a kept column named like a result is left out.
    """

    def values(texts: pa.Array) -> list[pa.Array]:
        ids = _encode(texts, vocabulary)
        return [pa.array(ids, type=pa.binary()), pa.array([len(x) // 4 for x in ids], type=pa.int64())]

    return _through(docs, text, keep, "ids binary, n_tokens long", values)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and ``decoded``, the text of each row's ids, special tokens included. Null ids give an empty text."""

    def values(column: pa.Array) -> list[pa.Array]:
        return [pa.array(encoder(vocabulary).decode([x or b"" for x in column.to_pylist()]), type=pa.string())]

    return _through(rows, ids, keep, "decoded string", values)


def digests(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_tokens, and SHA-256 of the ids and of the text decoded from them."""

    def values(texts: pa.Array) -> list[pa.Array]:
        ids = _encode(texts, vocabulary)
        decoded = encoder(vocabulary).decode(ids)
        return [
            pa.array([len(x) // 4 for x in ids], type=pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], type=pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], type=pa.string()),
        ]

    results = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _through(docs, text, keep, results, values)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of each document's whole text beside its other columns.

    The ids are decoded before they leave the task; the job fails if a text doesn't come back.
    """
    vocabulary = _vocabulary()

    def values(texts: pa.Array) -> list[pa.Array]:
        ids = _reversible(texts, vocabulary)
        return [pa.array(ids, type=pa.binary()), pa.array([len(x) // 4 for x in ids], type=pa.int64())]

    return _through(docs, "text", tuple(c for c in docs.columns if c != "text"), "ids binary, n_tokens long", values)
