"""Anchors: the smallest gram hash of each window, and runs of windows that share one.

A window of ``size`` items holds ``size - gram + 1`` grams; the one with the smallest hash (the
leftmost of several) is its anchor. Equal windows have equal anchors at equal offsets, so windows
need to be compared within one anchor only, and neighbouring windows mostly share theirs: they
form one run, which travels as one row.
"""

from __future__ import annotations

import numpy as np

#: Window starts worked on at once, and the low bits that hold a position among them.
PIECE = 1 << 20
_LOW = np.uint64(24)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    n, step = len(values) - width + 1, 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:n], values[width - step : width - step + n])


def anchor_runs(grams: np.ndarray, gram: int, size: int, bounds: np.ndarray):
    """Starts, window counts and anchor hashes of the runs of a chunk of rows.

    ``grams[p]`` is the hash of the gram at item ``p``; ``bounds`` are the rows' item offsets.
    No window crosses rows. A run longer than ``PIECE`` windows is cut.
    """
    items, width = int(bounds[-1]), size - gram + 1
    inside = np.zeros(max(items - size + 1, 0) + 1, np.int32)
    first, last = bounds[:-1], bounds[1:] - size + 1
    has = last > first
    np.add.at(inside, first[has], 1)
    np.add.at(inside, last[has], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int32) > 0
    found = []
    for a in range(0, len(inside), PIECE):
        b = min(a + PIECE, len(inside))
        part = grams[a : b + width - 1]
        ranked = (part >> _LOW << _LOW) | np.arange(len(part), dtype=np.uint64)
        at = (sliding_min(ranked, width) & np.uint64((1 << 24) - 1)).astype(np.int64) + a
        starts = np.flatnonzero(inside[a:b]) + a
        if not len(starts):
            continue
        at = at[starts - a]
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(at) != 0) | (np.diff(starts) != 1)
        heads = np.flatnonzero(new)
        found.append((starts[heads], np.diff(np.append(heads, len(starts))), grams[at[heads]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged_spans(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered spans as starts and ends, in order."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    heads = np.flatnonzero(new)
    return starts[heads], ends[np.append(heads[1:] - 1, len(starts) - 1)]
