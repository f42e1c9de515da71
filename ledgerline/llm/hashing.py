"""Vectorised words, windows and 64-bit hashes over the bytes of Arrow text columns.

Used inside tasks. A batch is worked through in chunks of a bounded number of bytes (a longer text
is a chunk of its own), so memory follows the chunk and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.uint64(0xD6E8FEB86659FD93)

#: Space, tab, line feed, vertical tab, form feed and carriage return separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIXERS[0]
    x ^= x >> np.uint64(27)
    x *= _MIXERS[1]
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64 = _BASE):
        self.base = base
        inverse = int(base)
        for _ in range(6):
            inverse = inverse * (2 - int(base) * inverse) % 2**64
        self.inverse = np.uint64(inverse)
        self._up = self._down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            for name, factor in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def up(self, n: int) -> np.ndarray:
        self._grow(n)
        return self._up[:n]

    def down(self, n: int) -> np.ndarray:
        self._grow(n)
        return self._down[:n]


class Spans:
    """Hashes of any span of a sequence of 64-bit values in constant time each."""

    def __init__(self, values: np.ndarray, powers: Powers):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers.up(len(values)), out=self.sums[1:])
        self.down = powers.down(len(values) + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + _ODD * (ends - starts).astype(np.uint64))


BYTE_POWERS = Powers()
WORD_POWERS = Powers(np.uint64(0xC2B2AE3D27D4EB4F))
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def row_chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of a single longer row."""
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


class Words:
    """The words of a chunk of texts: where they lie, their hashes, and the rows they belong to."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, lower: bool = False):
        """``bounds`` are the rows' offsets into ``raw``."""
        base = int(bounds[0])
        data = raw[base : int(bounds[-1])]
        rows = bounds - base
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[rows] = True
        opens = solid.copy()
        opens[1:] &= ~solid[:-1] | edge[1:-1]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.bounds = np.searchsorted(self.starts, rows)
        self.data = data
        codes = BYTE_CODES[LOWER[data] if lower else data]
        self.hashes = Spans(codes, BYTE_POWERS).hash(self.starts, self.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``size`` consecutive words and the offsets of each row's windows."""
        spans = Spans(self.hashes, WORD_POWERS)
        counts = np.maximum(np.diff(self.bounds) - size + 1, 0)
        offsets = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        first = np.arange(offsets[-1]) + np.repeat(self.bounds[:-1] - offsets[:-1], counts)
        return spans.hash(first, first + size), offsets
