"""Helpers for functions that run on Arrow batches: text as bytes, words as numpy spans.

A word is a run of bytes other than the space and the five ASCII controls 0x09-0x0D.
Hashes are polynomials modulo 2**64 over a fixed random value per byte, so the hash of
any span follows from two prefix sums and no Python loop runs over words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes handled at once inside a task; numpy needs some hundred times as much for a moment.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of ``column``; a longer text is a slice of its own."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    ends = np.cumsum(lengths, dtype=np.int64)
    first, rows = 0, batch.num_rows
    while first < rows:
        done = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(first, stop - first)
        first = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row begins, one more offset at the end; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes unchanged."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest slice seen."""
    global _powers, _inverses
    if len(_powers) < size:
        size = 1 << (size - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.cumprod(table, dtype=np.uint64)
    return _powers, _inverses


class SpanHashes:
    """Hashes of byte spans of one array."""

    def __init__(self, data: np.ndarray):
        powers, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data] * powers[: len(data)], dtype=np.uint64, out=self._sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._inverse[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice: byte spans, and for each row the number of its first word."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= solid[edges]
    stops[edges - 1] |= solid[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within a row, and each one's row.

    A row with fewer words gives one for its whole sequence, a row without words none.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]
    left = first[1:][row] - at
    out = np.zeros(len(row), dtype=np.uint64)
    for k in range(size):
        here = left > k
        out[here] = mix(out[here] * np.uint64(_BASE) + hashes[at[here] + k] + np.uint64(k + 1))
    return out, row



def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether spans that begin at ``a`` equal those that begin at ``b``, all of them."""
    if not len(a):
        return True
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    return bool(np.array_equal(data[np.repeat(a, lengths) + within], data[np.repeat(b, lengths) + within]))


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each span, the same for two spans exactly if their bytes are the same.

    Hashes bring equal spans together and bytes are compared; where two different spans
    share a hash, the bytes themselves are the keys.
    """
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, like = ends - starts, first[number]
    again = np.flatnonzero(like != np.arange(len(starts)))
    same = np.array_equal(lengths[again], lengths[like[again]])
    if same and _same_bytes(data, starts[again], starts[like[again]], lengths[again]):
        return number
    known: dict[bytes, int] = {}
    spans = (data[a:b].tobytes() for a, b in zip(starts, ends, strict=True))
    return np.fromiter((known.setdefault(span, len(known)) for span in spans), dtype=np.int64, count=len(starts))


def quiet_threads() -> None:
    """One thread for each task: Spark deals out the cores."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


assert sys.byteorder == "little", "digests and unpacked bits rely on little-endian words"
