"""Exact tokens of a byte-level BPE, with pieces of text encoded once per worker.

The pre-tokenizer of these vocabularies never joins a character that is not white
space to white space after it: each of its alternatives begins with the white space
and none looks back. So a text may be cut wherever a word character or printable ASCII
character is followed by a space, tab or line break, and the ids of the parts are the
ids of the whole. Added special strings hold no white space, so no cut divides one.
"""

from __future__ import annotations

import functools
import re
from array import array
from itertools import chain

import numpy as np

from lineforge.llm.arrow import quiet_threads

# Pieces remembered by a worker in each of two generations; when the younger is full it
# replaces the older one. Forgetting a piece costs its encoding anew, nothing else.
KNOWN_PIECES = 250_000
KNOWN_CHARS = 64  # longer pieces seldom come again
BATCH_BYTES = 4 << 20  # bytes encoded at once: the more, the fewer pieces are looked up twice

_CUT = re.compile(r"(?<=[\w!-~])(?=[ \t\r\n])")
_PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_UNSURE = re.compile(r"[^\w!-~ \t\r\n]")


def cuts(text: str) -> list[str]:
    """The text in parts that can be encoded apart."""
    if _UNSURE.search(text):
        return _CUT.split(text)
    return _PIECE.findall(text)


class Memory:
    """A mapping that forgets what was not used for long."""

    def __init__(self, size: int):
        self._size, self._young, self._old = size, {}, {}

    def get(self, key):
        value = self._young.get(key)
        if value is None and (value := self._old.get(key)) is not None:
            self.put(key, value)
        return value

    def known(self, keys) -> tuple[dict, list]:
        """What is remembered of several keys, and the others."""
        found, new = {}, []
        young, old = self._young, self._old
        for key in keys:
            if (value := young.get(key)) is not None:
                found[key] = value
            elif (value := old.get(key)) is not None:
                found[key] = value
                self.put(key, value)
            else:
                new.append(key)
        return found, new

    def put(self, key, value) -> None:
        if len(self._young) >= self._size:
            self._old, self._young = self._young, {}
        self._young[key] = value


def _packed(tokens) -> bytes:
    return array("I", tokens.ids).tobytes()


class Encoder:
    """Tokens of whole texts as the library gives them."""

    def __init__(self, path: str):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._ids, self._counts = Memory(KNOWN_PIECES), Memory(KNOWN_PIECES)

    def _look_up(self, parts: list[list[str]], memory: Memory, value) -> dict:
        found, new = memory.known(set(chain.from_iterable(parts)))
        encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        for piece, tokens in zip(new, encoded, strict=True):
            found[piece] = value(tokens)
            if len(piece) <= KNOWN_CHARS:
                memory.put(piece, found[piece])
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.ids_of_parts([cuts(t) for t in texts])

    def ids_of_parts(self, parts: list[list[str]]) -> list[bytes]:
        """Ids of texts that are cut already."""
        found = self._look_up(parts, self._ids, _packed)
        return [b"".join([found[p] for p in part]) for part in parts]

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        parts = [cuts(t) for t in texts]
        found = self._look_up(parts, self._counts, len)
        return [sum([found[p] for p in part]) for part in parts]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch(
            [np.frombuffer(x, dtype="<u4").tolist() for x in ids], skip_special_tokens=False
        )


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a worker, kept between its tasks."""
    return Encoder(path)
