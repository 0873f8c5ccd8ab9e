"""Word and window hashes of whole Arrow batches in numpy.

A word is a run of bytes outside space and \\t \\n \\v \\f \\r, which in UTF-8 equals a
run of characters outside them.  All hashes are fixed functions of the bytes, alike in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RNG.integers(0, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEPS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        have = np.full(max(n, 64), _BASES[which], dtype=np.uint64)
        have[0] = 1
        _powers[which] = have = np.multiply.accumulate(have)
    return have


def binary(column: pa.Array) -> pa.Array:
    """A text column as bytes, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())
    return column.fill_null(b"") if column.null_count else column


class Words:
    """The words of a list of texts: ``start`` and ``end`` are byte places in ``data``; text i has words first[i] to first[i + 1]."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        white = _WHITE[data]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(data) and not white[0]:
            edge = np.concatenate(([0], edge))
        self.data, self.start, self.end = data, edge[0::2], edge[1::2]
        begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))))
        self.first = np.searchsorted(self.start, begins)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash for each word; ``which`` takes one of two independent families."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.end - self.start
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
        values = _BYTES[which][self.data[place + np.repeat(self.start, lengths)]]
        total = np.add.reduceat(values * powers(int(lengths.max()), which)[place], offsets[:-1])
        return mix(total + lengths.astype(np.uint64))

    def windows(self, size: int, hashes: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of ``size`` consecutive words from each word on, and whether they all lie in its text."""
        n = len(hashes)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(min(size, n)):
            total[: n - k] += hashes[k:] * np.uint64(pow(_STEPS[which], k, 2**64))
        last = np.repeat(self.first[1:], np.diff(self.first))
        return mix(total), np.arange(n) + size <= last

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
