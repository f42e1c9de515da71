"""Benchmark decontamination by the q-gram lemma.

A copy of an item of ``m`` bytes with at most ``k`` edits keeps ``m - q + 1 - k * q`` of its q-grams,
all on diagonals (place in the text minus place in the item) that differ by at most ``k``. Shared
q-grams are counted in bands of diagonals that overlap by half, so each such range lies in one band
as a whole. Long grams are found by an index but bound little; in bands that reach their bound the
lemma is applied once more with short grams, which an opening that many items share does not pass.
What is left is verified by an alignment within the band.

Both sides are compared in lower case (ASCII and Latin-1), with anything but letters and digits as
one space. The edit budget is a share of the item's length, and smaller where the lemma needs it;
items of fewer than ``q`` bytes are too short to tell and match nothing. Texts are searched where
they are, in chunks, so nothing is shuffled and a passage in a third of all rows is no hot group. The
benchmark's index is broadcast in slices of bounded size, with a pass over the texts for each.

Null texts and null items match nothing; an item listed twice is found twice; repeated rows are
searched one by one; extra columns are left alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.hashing import BYTE_CODES, BYTE_POWERS, LOWER, Spans, row_chunks, text_buffers
from ledgerline.llm.tables import read, texts

Q = 10
EDIT_PERCENT = 8
SLICE_BYTES = 8 << 20
FILTER_BITS = 22
#: Short grams of the second count, and cells (band, diagonal, place) that are compared at once.
SHORT, CELLS = 4, 1 << 22

MATCH = "doc_id long, item_id long, start long, end long, edits int, passage string"

_TEXT = np.zeros(256, bool)
_TEXT[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def normalised(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with single spaces for all else, and where each was."""
    low = LOWER[data]
    capital = (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
    capital[0:1] = False
    capital[1:] &= low[:-1] == 0xC3
    low[capital] += 0x20
    solid = _TEXT[low]
    low[~solid] = 0x20
    kept = solid.copy()
    kept[1:] |= solid[:-1]
    at = np.flatnonzero(kept)
    return low[at], at


def grams(data: np.ndarray, q: int) -> np.ndarray:
    at = np.arange(max(len(data) - q + 1, 0))
    return Spans(BYTE_CODES[data], BYTE_POWERS).hash(at, at + q)


class Index:
    """Items of a slice of the benchmark, and where each q-gram occurs in them."""

    def __init__(self, items: list[tuple[int, str]], q: int, percent: int):
        self.q = q
        self.ids = [i for i, _ in items]
        self.items = [normalised(np.frombuffer(t.strip().encode(), np.uint8))[0].tobytes().strip() for _, t in items]
        self.sizes = sizes = np.array([len(x) for x in self.items], np.int64)
        self.budget = np.maximum(np.minimum(sizes * percent // 100, (sizes - q) // q), 0)
        self.least = np.maximum(sizes - q + 1 - self.budget * q, 1)
        found = [grams(np.frombuffer(x, np.uint8), q) for x in self.items]
        hashes = np.concatenate([*found, np.zeros(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(found)), [len(x) for x in found])[order]
        self.place = np.concatenate([*(np.arange(len(x)) for x in found), np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text place, item and item place of every shared q-gram."""
        found = grams(text, self.q)
        at = np.flatnonzero(self.filter[found >> np.uint64(64 - FILTER_BITS)])
        first = np.searchsorted(self.hashes, found[at])
        n = np.searchsorted(self.hashes, found[at], side="right") - first
        ends = np.cumsum(n)
        post = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)
        return np.repeat(at, n), self.item[post], self.place[post]

    def bands(self, row: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Row, item and lowest diagonal of the bands that reach the bound; bands are twice ``budget + 1`` wide."""
        step = self.budget[item] + 1
        band = (at - place) // step
        row, item, place = np.tile(row, 2), np.tile(item, 2), np.tile(place, 2)
        band = np.concatenate([band, band - 1])
        order = np.lexsort((place, band, item, row))
        row, item, place, band = row[order], item[order], place[order], band[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        fresh = new.copy()
        fresh[1:] |= place[1:] != place[:-1]
        heads = np.flatnonzero(new)
        counts = np.add.reduceat(fresh.astype(np.int64), heads) if len(heads) else heads
        for h in heads[counts >= self.least[item[heads]]]:
            yield int(row[h]), int(item[h]), int(band[h] * (self.budget[item[h]] + 1))


def short_gram_bound(index: Index, text: np.ndarray, starts: np.ndarray, stops: np.ndarray, items: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Which bands (of items in the texts that lie from ``starts`` to ``stops``) keep enough short grams.

    A gram counts once, on whichever diagonal of the band it stands.
    """
    kept = np.ones(len(items), bool)
    budgets = index.budget[items]
    sizes = index.sizes[items]
    for budget in np.unique(budgets):
        group = np.flatnonzero(budgets == budget)
        width = 2 * (int(budget) + 1)
        longest = int(sizes[group].max())
        step = max(1, CELLS // (width * longest))
        for a in range(0, len(group), step):
            part = group[a : a + step]
            letters = np.zeros((len(part), longest), np.uint8)  # 0 is in no text
            for i, k in enumerate(items[part]):
                letters[i, : sizes[part[i]]] = np.frombuffer(index.items[k], np.uint8)
            at = starts[part][:, None] + lows[part][:, None] + np.arange(width + longest - 1)
            inside = (at >= starts[part][:, None]) & (at < stops[part][:, None])
            region = np.where(inside, text[np.clip(at, 0, len(text) - 1)], 1)  # nor is 1
            diagonals = np.lib.stride_tricks.sliding_window_view(region, longest, axis=1)
            same = diagonals == letters[:, None, :]
            runs = same[..., SHORT - 1 :].copy()
            for i in range(SHORT - 1):
                runs &= same[..., i : same.shape[-1] - SHORT + 1 + i]
            found = runs.any(axis=1).sum(axis=1)
            kept[part] = found >= sizes[part] - SHORT + 1 - SHORT * budget
    return kept


def banded(item: np.ndarray, text: np.ndarray, low: int, width: int, free_start: bool) -> tuple[int, int]:
    """Fewest edits that turn ``item`` into a part of ``text``, and where the part ends.

    Only cells on diagonals ``low`` to ``low + width - 1`` are filled. The part starts anywhere if
    ``free_start``, else at 0.
    """
    n, far = len(text), len(item) + len(text) + 1
    diagonals = np.arange(low, low + width)
    steps = np.arange(width)
    cost = np.where((diagonals >= 0) & (diagonals <= n), 0 if free_start else np.abs(diagonals), far)
    padded = np.full(n + 2 * (width + len(item)) + abs(low) + 2, -1)
    shift = max(0, 1 - low)
    padded[shift : shift + n] = text
    for i, letter in enumerate(item, 1):
        at = diagonals + i
        over = np.append(cost[1:] + 1, far)
        same = cost + (padded[np.clip(at - 1 + shift, 0, len(padded) - 1)] != letter)
        cost = np.minimum(over, same)
        cost = np.minimum.accumulate(cost - steps) + steps
        cost[(at < 0) | (at > n)] = far
    best = int(np.argmin(cost))
    return int(cost[best]), int(diagonals[best] + len(item))


def align(item: bytes, text: bytes, low: int, budget: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the item in the text near diagonal ``low``, if within the budget."""
    width = 4 * budget + 3
    first = max(0, low - budget)
    exact = text.find(item, first, max(first, low + width + len(item)))
    if exact >= 0:
        return 0, exact, exact + len(item)
    if not budget:
        return None
    letters, held = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8).astype(np.int64)
    region = held[first : max(first, low + width + len(item) + budget)]
    edits, end = banded(letters, region, low - budget - first, width, True)
    if edits > budget:
        return None
    _, back = banded(letters[::-1], region[:end][::-1], -budget, 2 * budget + 1, False)
    return edits, first + end - back, first + end


def _leaks(batch: pa.RecordBatch, index: Index) -> Iterator[tuple[int, int, int, int, int, str]]:
    """Row, item_id, start, end, edits and passage of every place where an item lies in a text of the batch."""
    raw, bounds = text_buffers(batch.column("text"))
    for a, z in row_chunks(bounds):
        data = raw[bounds[a] : bounds[z]]
        text, origin = normalised(data)
        edges = np.searchsorted(origin, bounds[a : z + 1] - bounds[a])
        at, item, place = index.hits(text)
        row = np.searchsorted(edges, at, side="right") - 1
        inside = at + index.q <= edges[row + 1]
        at, item, place, row = at[inside], item[inside], place[inside], row[inside]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        bands = np.array(list(index.bands(row, at - edges[row], item, place)), np.int64).reshape(-1, 3)
        starts, stops = edges[bands[:, 0]], edges[bands[:, 0] + 1]
        for r, k, low in bands[short_gram_bound(index, text, starts, stops, bands[:, 1], bands[:, 2])].tolist():
            hit = align(index.items[k], text[edges[r] : edges[r + 1]].tobytes(), low, int(index.budget[k]))
            if hit:
                found.setdefault((r, k), []).append(hit)
        for (r, k), hits in found.items():
            taken: list[tuple[int, int]] = []
            for edits, s, e in sorted(hits):
                if all(e <= x or s >= y for x, y in taken):
                    taken.append((s, e))
                    first, last = int(origin[edges[r] + s]), int(origin[edges[r] + e - 1]) + 1
                    before = data[bounds[a + r] - bounds[a] : first].tobytes().decode(errors="ignore")
                    passage = data[first:last].tobytes().decode(errors="ignore")
                    yield r + a, index.ids[k], len(before), len(before) + len(passage), edits, passage


def matches(docs: DataFrame, index: Index) -> DataFrame:
    """A row per place where an item lies in a text; start and end count characters."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if out := list(_leaks(batch, held.value)):
                rows, *columns = zip(*out, strict=True)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                    ["doc_id", "item_id", "start", "end", "edits", "passage"],
                )

    return docs.mapInArrow(run, MATCH)


def index_slices(benchmark: DataFrame, q: int, edit_percent: int, slice_bytes: int) -> Iterator[Index]:
    """The benchmark's index in slices of about ``slice_bytes``; one at least."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    held, total, any_ = [], 0, False
    for item_id, text in items.toLocalIterator():
        held.append((item_id, text))
        total += len(text)
        if total >= slice_bytes:
            yield Index(held, q, edit_percent)
            held, total, any_ = [], 0, True
    if held or not any_:
        yield Index(held, q, edit_percent)


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_percent: int = EDIT_PERCENT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, start, end, edits, passage: every place of a benchmark item in a document."""
    docs = texts(docs)
    found = [matches(docs, index) for index in index_slices(benchmark, q, edit_percent, slice_bytes)]
    return functools.reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_percent: int = EDIT_PERCENT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no benchmark item."""
    for index in index_slices(benchmark, q, edit_percent, slice_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[leak[0] for leak in _leaks(batch, held.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark, folder: str) -> DataFrame:
    return find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
