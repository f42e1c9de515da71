"""Count-min sketches: one per partition, merged by slices, sent out as bits or counts.

A sketch has ``rows`` rows of ``2**bits`` cells, whatever the size of the corpus, so the merged
sketch has a proven size. Cells only ever overestimate: what occurs twice is never taken for
single. As a corpus outgrows the sketch, fewer items are ruled out early; results stay the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ledgerline.llm.hashing import mix

SLICE_BITS = 19
#: New cells of a partition that are gathered before they are added to its sketch.
PENDING = 1 << 20
#: Tasks that add up slices; each holds its share of the sketch.
MERGERS = 32
PART = "part int, cells binary, counts binary"


class Cells:
    """Where hashes lie in a sketch."""

    def __init__(self, rows: int, bits: int):
        self.rows, self.bits = rows, bits

    def of(self, hashes: np.ndarray, row: int) -> np.ndarray:
        seeded = mix(hashes + np.uint64((0x9E3779B97F4A7C15 * (row + 1)) % 2**64))
        return (seeded >> np.uint64(64 - self.bits)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Small numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.compress(planes.T.tobytes(), 1)


def unpacked(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    planes = planes.reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def merged(
    docs: DataFrame,
    hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]],
    rows: int,
    bits: int,
    kind: type = np.uint8,
    finish: Callable[[np.ndarray], np.ndarray] = lambda counts: counts,
) -> list[np.ndarray]:
    """Counts of the items that ``hashes`` gives for batches of ``docs``, a row of the sketch each.

    Counts stop at the largest ``kind``. Partition sketches travel as their filled cells; each
    slice is added up as a stream, so a merging task holds the slices dealt to it and nothing else.
    ``finish`` turns the counts of a slice into what is sent to the driver.
    """
    cells, width, most = Cells(rows, bits), 1 << min(bits, SLICE_BITS), int(np.iinfo(kind).max)
    slices = (1 << bits) // width

    def record(part: int, at: bytes, counts: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at]), pa.array([counts])], ["part", "cells", "counts"])

    def filled(pending: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells in order and their counts."""
        at, n = (np.concatenate(x) for x in zip(*pending, strict=True))
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        heads = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else order
        sums = np.add.reduceat(n.astype(np.int64), heads) if len(at) else n
        return at[heads], np.minimum(sums, most).astype(kind)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Filled cells only, at most ``rows * 2**bits`` however large the partition is."""
        pending = [[(np.zeros(0, np.uint32), np.zeros(0, kind))] for _ in range(rows)]
        for batch in batches:
            for found in hashes(batch):
                for row in range(rows):
                    at = cells.of(found, row).astype(np.uint32)
                    pending[row].append((at, np.ones(len(at), kind)))
                    if sum(len(x) for x, _ in pending[row][1:]) > max(PENDING, len(pending[row][0][0])):
                        pending[row] = [filled(pending[row])]
        for row in range(rows):
            at, counts = filled(pending[row])
            cuts = np.searchsorted(at, np.arange(slices + 1, dtype=np.int64) * width)
            for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if e > s:
                    yield record(row * slices + k, packed(np.diff(at[s:e].astype(np.int64) - k * width, prepend=0).astype(np.uint32)), packed(counts[s:e]))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault(part, np.zeros(width, kind))
                at = np.cumsum(unpacked(at, np.uint32), dtype=np.int64)
                held[at] = np.minimum(held[at].astype(np.int64) + unpacked(n, kind), most)
        for part, held in sums.items():
            yield record(part, b"", finish(held).tobytes())

    parts = docs.mapInArrow(partial, PART).repartition(min(MERGERS, rows * slices), "part").mapInArrow(total, PART)
    blank = finish(np.zeros(width, kind))
    out = [np.zeros(slices * len(blank), blank.dtype) for _ in range(rows)]
    for found in parts.collect():  # rows * slices rows of fixed size
        row, k = divmod(found["part"], slices)
        out[row][k * len(blank) : (k + 1) * len(blank)] = np.frombuffer(found["counts"], blank.dtype)
    return out


def twice(counts: np.ndarray) -> np.ndarray:
    return np.packbits(counts >= 2, bitorder="little")


class Repeats:
    """A merged sketch cut down to a bit a cell: may the item occur twice or more?"""

    def __init__(self, rows: list[np.ndarray]):
        self.cells, self.rows = Cells(len(rows), (len(rows[0]) * 8).bit_length() - 1), rows

    @classmethod
    def of(cls, docs: DataFrame, hashes, rows: int, bits: int) -> Repeats:
        return cls(merged(docs, hashes, rows, bits, finish=twice))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        kept = np.ones(len(hashes), bool)
        for row, bits in enumerate(self.rows):
            at = self.cells.of(hashes, row)
            kept &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return kept


#: Neighbouring cells whose counts are added up to tell how common an item is.
FOLD = 16


def _levels(counts: np.ndarray) -> np.ndarray:
    """Three bit planes: cells of two items or more, then groups of cells far above the usual count,
    and those again eight times above that. The usual count follows the corpus."""
    sums = counts.reshape(-1, min(FOLD, len(counts))).sum(axis=1, dtype=np.int64)
    usual = float(np.median(sums))
    common = math.ceil(usual + 6 * math.sqrt(usual) + 8)
    return np.concatenate([twice(counts), *(np.packbits(sums > most, bitorder="little") for most in (common, 8 * common))])


class Commonness:
    """A merged sketch of one row, cut down to how common an item is: 0 if it occurs once, else 1 to 3.

    Items are only ever taken for too common. As the cells fill up, fewer single items are told; the
    common ones still are.
    """

    def __init__(self, planes: np.ndarray, bits: int):
        self.cells, self.width = Cells(1, bits), 1 << min(bits, SLICE_BITS)
        self.fold = min(FOLD, self.width)
        cuts = np.cumsum([-(-self.width // 8), -(-self.width // self.fold // 8)])
        self.planes = np.split(planes.reshape((1 << bits) // self.width, -1), cuts, axis=1)

    @classmethod
    def of(cls, docs: DataFrame, hashes, bits: int) -> Commonness:
        return cls(merged(docs, hashes, 1, bits, finish=_levels)[0], bits)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        part, at = np.divmod(self.cells.of(hashes, 0), self.width)
        folded = at // self.fold
        often, common, most = (
            (plane[part, place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(np.int8)
            for plane, place in zip(self.planes, (at, folded, folded), strict=True)
        )
        return often * (1 + common + most)
