"""Counts of 64-bit keys over a whole corpus, and looking them up where the rows are.

Keys are counted in the tasks first. The most frequent ones, a fixed number at most, are sent to all
tasks; the others are joined by a shuffle, in which no key has more rows than the least frequent key
of the first kind, so no task gets a hot one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: New keys that a task gathers before it adds equal ones up; distinct keys that it holds at most.
PENDING = 1 << 20
HELD = 1 << 22
BATCH = 1 << 16
#: Classes of counts between a number and its double, from which the frequent keys are chosen.
STEPS = 8


class Tally:
    """Sums per key, one or several numbers each."""

    def __init__(self, numbers: int):
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros((0, numbers), np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self.pending.append((keys, numbers))
        self.waiting += len(keys)
        if self.waiting > max(PENDING, len(self.keys)):
            self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.pending)])
        sums = np.concatenate([self.sums, *(s for _, s in self.pending)])
        order = np.argsort(keys)
        keys, sums = keys[order], sums[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
        self.keys = keys[heads]
        self.sums = np.add.reduceat(sums, heads, axis=0) if len(keys) else sums
        self.pending, self.waiting = [], 0

    def taken(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """All sums as rows; the tally is empty afterwards."""
        self.fold()
        for a in range(0, len(self.keys), BATCH):
            part = self.sums[a : a + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[a : a + BATCH]), *(pa.array(np.ascontiguousarray(c)) for c in part.T)], ["key", *names])
        self.keys, self.sums = self.keys[:0], self.sums[:0]


def counted(rows: DataFrame, found: Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray]]], names: list[str]) -> DataFrame:
    """key and the sums of ``names`` over all keys and numbers that ``found`` gives for batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(len(names))
        for batch in batches:
            for keys, numbers in found(batch):
                tally.add(keys, numbers)
                if len(tally.keys) > HELD:
                    yield from tally.taken(names)
        yield from tally.taken(names)

    schema = ", ".join(f"{n} long" for n in ("key", *names))
    return rows.mapInArrow(run, schema).groupBy("key").agg(*[F.sum(n).alias(n) for n in names])


@dataclass
class Head:
    """The most frequent keys in order, and columns beside them."""

    keys: np.ndarray
    columns: dict[str, np.ndarray]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is held, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


def head_and_tail(counts: DataFrame, frequency: str, most: int) -> tuple[Head, DataFrame]:
    """At most ``most`` of the most frequent keys with all their columns, and the table of all others."""
    step = F.floor(STEPS * F.log2(F.col(frequency)))
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # some hundred rows
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r.step):
        total += r.n
        if total > most:
            break
        least = r.step
    kept = F.lit(False) if least is None else step >= F.lit(least)
    found = counts.where(kept).toArrow()
    columns = {n: found.column(n).to_numpy() for n in found.column_names}
    order = np.argsort(columns["key"])
    columns = {n: c[order] for n, c in columns.items()}
    return Head(columns.pop("key"), columns), counts.where(~kept)
