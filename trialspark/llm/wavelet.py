"""Wavelet matrix over token ids: succinct bit planes with rank and select, in one compressed block of bytes.

The block holds one bit plane per bit of the largest id, highest first; after each plane the sequence is stably parted into
zeros and ones. A plane is cut into chunks of ``CHUNK_BITS`` bits, each compressed by itself, with the number of ones before it,
so a question about one token or one id opens a chunk or two of each plane and leaves the rest packed.

Layout, little endian: magic ``WMX2``, n (u64), planes (u32), documents (u32), zeros of each plane (u64), document lengths (u64),
ones before each chunk of each plane and its end (u64), byte offsets of the chunks (u64), then the chunks: zstandard frames, or
plain bytes where those are no longer.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WMX2"
HEAD = "<4sQII"
CHUNK_BITS = 1 << 15


def build(ids: np.ndarray, lengths: np.ndarray, bits: int) -> bytes:
    """Serialise ``ids`` (unsigned, below ``2**bits``) of documents with the given lengths."""
    pack = zstandard.ZstdCompressor(level=1).compress
    sequence, zeros, ranks, chunks = ids, [], [], []
    for bit in range(bits - 1, -1, -1):
        flag = ((sequence >> bit) & 1).astype(bool)
        plane = np.packbits(flag)
        parts = [plane[a : a + CHUNK_BITS // 8].tobytes() for a in range(0, len(plane), CHUNK_BITS // 8)]
        chunks += [min(p, pack(p), key=len) for p in parts]
        ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), CHUNK_BITS // 8), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        low = sequence[~flag]
        zeros.append(len(low))
        sequence = np.concatenate([low, sequence[flag]])
    tables = [np.array(zeros), np.asarray(lengths), np.array(ranks).ravel(), np.cumsum([0, *map(len, chunks)])]
    return struct.pack(HEAD, MAGIC, len(ids), bits, len(lengths)) + b"".join([t.astype("<u8").tobytes() for t in tables] + chunks)


class WaveletMatrix:
    """One opened block. Positions run over the tokens of the block, symbols are token ids."""

    def __init__(self, block: bytes):
        magic, self.n, self.bits, docs = struct.unpack_from(HEAD, block)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix block")
        self.per_plane = -(-self.n // CHUNK_BITS)
        at, tables = struct.calcsize(HEAD), []
        for size in (self.bits, docs, self.bits * (self.per_plane + 1), self.bits * self.per_plane + 1):
            tables.append(np.frombuffer(block, "<u8", size, at).astype(np.int64))
            at += 8 * size
        self.zeros, self.lengths, ranks, self.offsets = tables
        self.ranks = ranks.reshape(self.bits, -1)
        self.block, self.body = block, at
        self.opened = 0  # chunks that had to be unpacked
        self._chunk = lru_cache(maxsize=64)(self._unpack)

    def _unpack(self, level: int, chunk: int) -> np.ndarray:
        self.opened += 1
        i = level * self.per_plane + chunk
        raw = self.block[self.body + self.offsets[i] : self.body + self.offsets[i + 1]]
        size = (min(CHUNK_BITS, self.n - chunk * CHUNK_BITS) + 7) // 8
        return np.frombuffer(raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw, max_output_size=size), np.uint8)

    def tokens(self) -> np.ndarray:
        """All ids in order, plane by plane from the lowest bit back to the highest."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        sequence = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1) if self.n else ():
            flag = np.unpackbits(np.concatenate([self._unpack(level, c) for c in range(self.per_plane)]), count=self.n).astype(bool)
            parted, z = sequence, int(self.zeros[level])
            sequence = np.empty(self.n, kind)
            sequence[~flag] = parted[:z]
            sequence[flag] = parted[z:] | kind(1 << (self.bits - 1 - level))
        return sequence

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before ``at``: those before its chunk, then whole bytes, then bits."""
        chunk, bit = divmod(at, CHUNK_BITS)
        found = int(self.ranks[level, chunk])
        if bit:
            data = self._chunk(level, chunk)
            found += int(np.bitwise_count(data[: bit // 8]).sum())
            found += (int(data[bit // 8]) >> (8 - bit % 8)).bit_count() if bit % 8 else 0
        return found

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        symbol = 0
        for level in range(self.bits):
            before = self._ones(level, at)
            bit = self._ones(level, at + 1) - before
            symbol = symbol << 1 | bit
            at = int(self.zeros[level]) + before if bit else at - before
        return symbol

    def _span(self, symbol: int, at: int) -> tuple[int, int]:
        first, last = 0, at
        for level in range(self.bits):
            a, b = self._ones(level, first), self._ones(level, last)
            if symbol >> (self.bits - 1 - level) & 1:
                first, last = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                first, last = first - a, last - b
        return first, last

    def rank(self, symbol: int, at: int) -> int:
        """Occurrences of an id before a position."""
        if symbol >> self.bits:
            return 0
        first, last = self._span(symbol, min(at, self.n))
        return last - first

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Position of the ``k``-th occurrence (from 0) of an id."""
        if symbol >> self.bits or not 0 <= k < self.count(symbol):
            raise IndexError(k)
        at = self._span(symbol, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - level) & 1
            at = self._place(level, one, at - int(self.zeros[level]) if one else at)
        return at

    def _place(self, level: int, one: int, k: int) -> int:
        """Position of the ``k``-th one or zero of a plane: by the counts before the chunks, then inside one chunk."""
        ranks = self.ranks[level]
        before = ranks if one else np.minimum(np.arange(len(ranks)) * CHUNK_BITS, self.n) - ranks
        chunk = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._chunk(level, chunk), count=min(CHUNK_BITS, self.n - chunk * CHUNK_BITS))
        return chunk * CHUNK_BITS + int(np.flatnonzero(bits == one)[k - int(before[chunk])])
