"""Vectorised words, lines and hashes of a batch of UTF-8 texts (numpy, inside tasks).

Texts are handled as bytes laid end to end with a line feed after each. A word is a maximal run of bytes other than the six
white-space bytes. Hashes are 64-bit polynomial sums over a fixed byte table; they are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15
#: Texts are processed in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 21
#: Slices are hashed in pieces of about so many bytes, so that a very long text needs about 16 bytes of memory a byte.
PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_TABLE = mix(np.arange(1, 257, dtype=U) * U(_P))


@lru_cache(maxsize=4)
def _powers(size: int) -> np.ndarray:
    up = np.full(size, _P, U)
    up[0] = 1
    return np.multiply.accumulate(up)


def grouped(texts: Sequence, limit: int = GROUP_BYTES, size: Callable = lambda text: len(text) if text else 0) -> Iterator[slice]:
    """Slices of ``texts`` (or of their sizes) of about ``limit`` bytes."""
    start = total = 0
    for i, text in enumerate(texts):
        n = size(text)
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))


class Words:
    """``data`` (all bytes), ``doc_at`` (start of each text), ``start``/``end``/``doc`` of each word, words per text."""

    def __init__(self, texts: Sequence[bytes | None], *, lower: bool = False):
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        data = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
        self.data = LOWER[data] if lower else data
        self.doc_end = np.cumsum(sizes)
        self.doc_at = self.doc_end - sizes
        self.space = SPACE[data]
        edge = np.diff(self.space.astype(np.int8), prepend=1)
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)  # the last byte is white space, so every word ends
        first = np.searchsorted(self.start, self.doc_at)
        self.first_word = first
        self.n_words = np.diff(first, append=len(self.start))
        self.doc = np.repeat(np.arange(len(sizes)), self.n_words)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte slice ``[start, end)``; the slices are ascending, disjoint and not empty."""
        out = np.zeros(len(start), U)
        first = 0
        while first < len(start):
            last = max(first + 1, int(np.searchsorted(end, start[first] + PIECE_BYTES, side="right")))
            s, e = start[first:last], end[first:last]
            begin, stop = int(s[0]), int(e[-1])
            sizes = np.diff(s, append=stop)
            place = np.arange(stop - begin) - np.repeat(s - begin, sizes)
            parts = _TABLE[self.data[begin:stop]] * _powers(1 << max(12, int(sizes.max()).bit_length()))[place]
            edges = np.column_stack([s - begin, e - begin]).ravel()[:-1]  # the last slice ends with the piece
            out[first:last] = mix(np.add.reduceat(parts, edges)[::2] + (e - s).astype(U))
            first = last
        return out

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of all ``size``-word windows inside one text, and the windows' hashes."""
        if len(hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        n = len(hashes) - size + 1
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        total = np.zeros(n, U)
        for k in range(size):
            total = total * U(_P) + hashes[k : k + n]
        return at, mix(total[at])

    def sum_by_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        return np.add.reduceat(flags, self.doc_at, dtype=np.int64) if len(self.doc_at) else np.zeros(0, np.int64)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether an equal key stands before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later
