"""Suffix-array dedup: bytes of a string that also starts earlier are removed, the first copy stays.

A text is cut into segments: runs of windows of ``size`` bytes that share an anchor (see
``anchors``), each ``size - 1`` bytes longer than its run. Equal windows have equal anchors, so
all copies of a window meet under one anchor. Equal segments are folded into the earliest one
before anything else, which also folds hot passages; the segments left that share an anchor are
laid side by side, a suffix array orders all their suffixes, and the previous and next smaller
positions in that order (smaller: an earlier place in the corpus) give the longest previous factor
of every position. Windows whose factor is ``size`` bytes or more have an earlier copy.

Earlier means a smaller doc_id, or an earlier start in the same document; null ids come first.
Rows that share doc_id and text are one document: neither is earlier, both get the same result.
Rows that share a doc_id only are ordered by a hash of their texts. Nulls count as empty texts;
texts shorter than ``size`` bytes lose nothing. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.anchors import anchor_runs, merged_spans
from ledgerline.llm.hashing import BYTE_CODES, BYTE_POWERS, Spans, row_chunks, text_buffers
from ledgerline.llm.sketch import Repeats
from ledgerline.llm.tables import read, stored
from ledgerline.llm.window_dedup import as_longs, marked

SIZE = 100
GRAM = 32
SKETCH_ROWS, SKETCH_BITS = 2, 26
#: Anchors with more different segments than this are resolved window by window instead.
MAX_SEGMENTS = 4096
#: Suffixes are sorted in chunks of whole anchors of about so many bytes.
CHUNK_BYTES = 1 << 20

SEGMENT = "anchor long, digest long, doc_id long, mark long, first long, windows int"
SPAN = "doc_id long, mark long, first long, n_bytes long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _segments(raw: np.ndarray, bounds: np.ndarray, size: int, gram: int):
    rows = bounds - bounds[0]
    spans = Spans(BYTE_CODES[raw[bounds[0] : bounds[-1]]], BYTE_POWERS)
    at = np.arange(max(int(rows[-1]) - gram + 1, 0))
    return rows, spans, anchor_runs(spans.hash(at, at + gram), gram, size, rows)


def _anchors(size: int, gram: int):
    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        raw, bounds = text_buffers(batch.column("text"))
        for a, z in row_chunks(bounds):
            yield _segments(raw, bounds[a : z + 1], size, gram)[2][2]

    return anchors


def repeated_segments(docs: DataFrame, size: int, gram: int, rows: int, bits: int) -> DataFrame:
    """Segments whose anchor a merged sketch of all anchors takes for repeated."""
    maybe = docs.sparkSession.sparkContext.broadcast(Repeats.of(docs.select("text"), _anchors(size, gram), rows, bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_buffers(batch.column("text"))
            for a, z in row_chunks(bounds):
                rows, spans, (starts, counts, anchors) = _segments(raw, bounds[a : z + 1], size, gram)
                kept = maybe.value(anchors)
                starts, counts = starts[kept], counts[kept]
                row = np.searchsorted(rows, starts, side="right") - 1
                of = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        as_longs(anchors[kept]),
                        as_longs(spans.hash(starts, starts + counts + size - 1)),
                        batch.column("doc_id").take(of),
                        batch.column("mark").take(of),
                        pa.array(starts - rows[row], pa.int64()),
                        pa.array(counts.astype(np.int32)),
                    ],
                    ["anchor", "digest", "doc_id", "mark", "first", "windows"],
                )

    return docs.mapInArrow(emit, SEGMENT)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes by their first ``depth`` or more items, and the ranks by doubling.

    ``data`` holds positive codes; shorter suffixes come first. ``ranks[k]`` orders by ``2**k`` items.
    """
    n = len(data)
    ranks, length = [np.append(data.astype(np.int64), 0)], 1
    while True:
        now = ranks[-1]
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - length, 0)] = now[length:n]
        pairs = now[:n] * (int(now.max()) + 1) + ahead
        order = np.argsort(pairs, kind="stable")
        steps = np.ones(n, np.int64)
        steps[1:] = np.diff(pairs[order]) != 0
        rank = np.zeros(n + 1, np.int64)
        rank[order] = np.cumsum(steps)
        ranks.append(rank)
        length *= 2
        if length >= depth:
            return order, ranks


def common_prefixes(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes ``i`` and ``j``, up to ``2**len(ranks) - 1``."""
    end = len(ranks[0]) - 1
    found = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = np.minimum(i + found, end), np.minimum(j + found, end)
        found += (1 << k) * ((ranks[k][a] == ranks[k][b]) & (a < end) & (b < end))
    return found


def previous_smaller(when: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it, in order, that is earlier.

    ``when`` gives the suffixes' places in the corpus in suffix order and ``near`` each one's
    common prefix with its predecessor. Pointers jump over suffixes known to be later.
    """
    to = np.arange(len(when)) - 1
    least = near.copy()
    open_ = np.flatnonzero(to >= 0)
    open_ = open_[when[to[open_]] > when[open_]]
    while len(open_):
        over = to[open_]
        jumps, shared = to[over], np.minimum(least[open_], least[over])
        to[open_], least[open_] = jumps, shared
        open_ = open_[jumps >= 0]
        open_ = open_[when[to[open_]] > when[open_]]
    return np.where(to >= 0, least, 0)


def longest_previous_factors(when: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with any earlier one, in suffix order."""
    back = np.append(near[1:], 0)[::-1]
    return np.maximum(previous_smaller(when, near), previous_smaller(when[::-1], back)[::-1])


def later_windows(segments: list[bytes], size: int) -> list[np.ndarray]:
    """For segments in corpus order: the starts of windows that also start earlier in the list."""
    lengths = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8).astype(np.int64) + 2
    ends = np.cumsum(lengths + 1) - 1
    data[ends] = np.arange(len(segments)) + 258  # no common prefix goes past a segment
    order, ranks = suffix_array(data, size)
    starts = np.repeat(ends - lengths, np.maximum(lengths - size + 1, 0))
    offsets = np.cumsum(np.maximum(lengths - size + 1, 0))
    starts = starts + np.arange(len(starts)) - np.repeat(np.append(0, offsets[:-1]), np.maximum(lengths - size + 1, 0))
    whole = np.zeros(len(data), bool)
    whole[starts] = True
    order = order[whole[order]]
    near = np.zeros(len(order), np.int64)
    near[1:] = common_prefixes(ranks[:-1], order[:-1], order[1:])
    later = np.sort(order[longest_previous_factors(order, near) >= size])
    which = np.searchsorted(ends, later)
    cuts = np.searchsorted(which, np.arange(len(segments) + 1))
    return [later[cuts[k] : cuts[k + 1]] - (ends[k] - lengths[k]) for k in range(len(segments))]


def _factors(size: int):
    """Spans with an earlier copy, from rows sorted by anchor and place."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        # Anchors share a chunk: windows of different anchors are never equal.
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        found = later_windows([x[3] for x in held], size)
        out = [(*x[:2], x[2] + int(s), int(e - s)) for x, w in zip(held, found, strict=True) for s, e in zip(*merged_spans(w, np.full(len(w), size)), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "mark", "first", "n_bytes"])

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, total = [], None, 0
        for batch in batches:
            for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "mark", "first", "segment")), strict=True):
                if anchor != last and total >= CHUNK_BYTES:
                    yield solve(held)
                    held, total = [], 0
                held.append(tuple(row))
                last, total = anchor, total + len(row[3])
        if held:
            yield solve(held)

    return factors


def _cut_segments(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_buffers(batch.column("text"))
            out: list[tuple] = []
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                text = raw[bounds[i] : bounds[i + 1]].tobytes()
                for s in wanted:
                    out.append((s["anchor"], s["crowded"], i, s["first"], text[s["first"] : s["first"] + s["windows"] + size - 1]))
            anchor, crowded, row, first, segment = zip(*out, strict=True) if out else [[]] * 5
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(crowded, pa.bool_()), batch.column("doc_id").take(row), batch.column("mark").take(row), pa.array(first, pa.int64()), pa.array(segment, pa.binary())],
                ["anchor", "crowded", "doc_id", "mark", "first", "segment"],
            )

    return cut


def _windows(size: int):
    """A row a window of a crowded anchor, under two hashes of its bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, mark, first, segment in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "first", "segment")), strict=True):
                for k in range(len(segment) - size + 1):
                    out.append((hashlib.blake2b(segment[k : k + size], digest_size=16).digest(), doc, mark, first + k))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["window", "doc_id", "mark", "first"],
            )

    return windows


def later_spans(docs: DataFrame, size: int, gram: int, rows: int, bits: int, most: int) -> DataFrame:
    """doc_id, mark, first, n_bytes: spans covered by windows with an earlier copy, not yet merged."""
    segments = stored(repeated_segments(docs, size, gram, rows, bits))
    kinds = stored(
        segments.groupBy("anchor", "digest").agg(
            F.min(F.struct("doc_id", "mark", "first", "windows")).alias("at"), F.count(F.lit(1)).alias("n")
        )
    )
    at = F.struct("doc_id", "mark", "first", "windows")
    copies = (
        segments.join(kinds.where("n > 1").select("anchor", "digest", "at"), ["anchor", "digest"])
        .where(at != F.col("at"))
        .select("doc_id", "mark", "first", (F.col("windows") + (size - 1)).cast("long").alias("n_bytes"))
    )
    shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = (
        kinds.join(shared, "anchor")
        .select("at.doc_id", "at.mark", F.struct("anchor", (F.col("kinds") > most).alias("crowded"), "at.first", "at.windows").alias("wanted"))
        .groupBy("doc_id", "mark")
        .agg(F.collect_list("wanted").alias("wanted"))
    )
    left, right = docs.dropDuplicates(["doc_id", "mark"]).alias("d"), wanted.alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.mark") == F.col("w.mark"))
    cut = stored(
        left.join(right, same)
        .select("d.doc_id", "d.mark", "d.text", "w.wanted")
        .mapInArrow(_cut_segments(size), "anchor long, crowded boolean, doc_id long, mark long, first long, segment binary")
    )
    factors = cut.where("not crowded").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_factors(size), SPAN)
    windows = cut.where("crowded").mapInArrow(_windows(size), "window binary, doc_id long, mark long, first long")
    place = F.struct("doc_id", "mark", "first")
    earliest = windows.groupBy("window").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    single = windows.join(earliest, "window").where(place != F.col("at")).select("doc_id", "mark", "first", F.lit(size).cast("long").alias("n_bytes"))
    return copies.unionByName(factors).unionByName(single)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffers(batch.column("text"))
        out: dict[str, list] = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i, found in enumerate(batch.column("spans").to_pylist()):
            text = raw[bounds[i] : bounds[i + 1]]
            first, length = np.array([(s["first"], s["n_bytes"]) for s in found or []], np.int64).reshape(-1, 2).T
            starts, ends = merged_spans(first, length)
            kept = np.ones(len(text), bool)
            for s, e in zip(starts, ends, strict=True):
                kept[s:e] = False
            rest = text[kept].tobytes()
            for name, value in zip(out, (len(text), len(text) - len(rest), len(starts), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                out[name].append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["doc_id", *out])


def remove_later_copies(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, sketch_rows: int = SKETCH_ROWS, sketch_bits: int = SKETCH_BITS, max_segments: int = MAX_SEGMENTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    docs = marked(docs)
    spans = (
        later_spans(docs, size, gram, sketch_rows, sketch_bits, max_segments)
        .groupBy("doc_id", "mark")
        .agg(F.collect_set(F.struct("first", "n_bytes")).alias("spans"))
    )
    left, right = docs.alias("d"), spans.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.mark") == F.col("s.mark"))
    return left.join(right, same, "left").select("d.doc_id", "d.text", "s.spans").mapInArrow(_keep, RESULT)


def op8_suffix_dedup(spark, folder: str) -> DataFrame:
    return remove_later_copies(read(spark, folder, "documents")).drop("kept")
