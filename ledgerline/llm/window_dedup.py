"""Substring dedup: words covered by a window of words that also starts elsewhere are removed.

A count-min prefilter rules out windows that occur once. Partition sketches count the anchors of
windows (see ``anchors``), whose counts are at least those of the windows they stand for, and are
merged. A second pass over the texts takes the windows estimated repeated, and only those, and
groups them exactly: first runs of windows as a whole, so that copies of a text cost a row a run
and a hot passage is counted before the shuffle; then, within anchors that several different runs
share, window by window.

Nulls count as empty texts. Rows of one doc_id are told apart by their text; repeated rows repeat
each other's windows. Texts shorter than a window lose nothing. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.anchors import anchor_runs, merged_spans
from ledgerline.llm.hashing import WORD_POWERS, Spans, Words, row_chunks, text_buffers
from ledgerline.llm.sketch import Repeats
from ledgerline.llm.tables import read, stored, texts

WINDOW = 35
GRAM = 20
SKETCH_ROWS, SKETCH_BITS = 2, 26

RUN = "anchor long, digest long, doc_id long, mark long, first int, windows int, hashes binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def marked(docs: DataFrame) -> DataFrame:
    """Documents with a mark of their text, which tells rows of one doc_id apart."""
    return texts(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def as_longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def _runs(words: Words, size: int, gram: int):
    spans = Spans(words.hashes, WORD_POWERS)
    at = np.arange(max(len(words.hashes) - gram + 1, 0))
    return spans, anchor_runs(spans.hash(at, at + gram), gram, size, words.bounds)


def _anchors(size: int, gram: int):
    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        raw, bounds = text_buffers(batch.column("text"))
        for a, z in row_chunks(bounds):
            yield _runs(Words(raw, bounds[a : z + 1]), size, gram)[1][2]

    return anchors


def repeated_runs(docs: DataFrame, maybe, size: int, gram: int, with_hashes: bool) -> DataFrame:
    """Runs of windows whose anchor the broadcast sketch ``maybe`` takes for repeated."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_buffers(batch.column("text"))
            for a, z in row_chunks(bounds):
                words = Words(raw, bounds[a : z + 1])
                spans, (starts, counts, anchors) = _runs(words, size, gram)
                kept = maybe.value(anchors)
                starts, counts, anchors = starts[kept], counts[kept], anchors[kept]
                if not len(starts):
                    continue
                row = np.searchsorted(words.bounds, starts, side="right") - 1
                ends = np.cumsum(counts)
                at = np.arange(ends[-1]) + np.repeat(starts - ends + counts, counts)
                hashes = spans.hash(at, at + size).tobytes() if with_hashes else b""
                cuts = np.append(0, ends * 8 if with_hashes else 0 * ends).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        as_longs(anchors),
                        as_longs(spans.hash(starts, starts + counts + size - 1)),
                        batch.column("doc_id").take(pa.array(row + a)),
                        batch.column("mark").take(pa.array(row + a)),
                        pa.array((starts - words.bounds[row]).astype(np.int32)),
                        pa.array(counts.astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(hashes)]),
                    ],
                    ["anchor", "digest", "doc_id", "mark", "first", "windows", "hashes"],
                )

    return docs.mapInArrow(emit, RUN)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a window, for runs that compete for an anchor."""
    for batch in batches:
        hashes = [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
        n = np.array([len(x) for x in hashes], np.int64)
        row = pa.array(np.repeat(np.arange(len(n)), n))
        at = np.concatenate([np.arange(x) for x in n]) if len(n) else n
        first = batch.column("first").take(row).to_numpy(zero_copy_only=False) + at
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("anchor").take(row),
                as_longs(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)),
                batch.column("n").take(row),
                batch.column("doc_id").take(row),
                batch.column("mark").take(row),
                pa.array(first.astype(np.int32)),
            ],
            ["anchor", "window", "n", "doc_id", "mark", "first"],
        )


def repeated_spans(docs: DataFrame, size: int, gram: int, rows: int, bits: int) -> DataFrame:
    """doc_id, mark, first, n_words: spans of words that repeated windows cover, not yet merged."""
    maybe = docs.sparkSession.sparkContext.broadcast(Repeats.of(docs.select("text"), _anchors(size, gram), rows, bits))
    kinds = stored(
        repeated_runs(docs, maybe, size, gram, with_hashes=True)
        .groupBy("anchor", "digest").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("hashes").alias("hashes"),
            F.min(F.struct("doc_id", "mark", "first")).alias("at"),
        )
    )
    # The runs are found again, which costs less than keeping them.
    runs = repeated_runs(docs, maybe, size, gram, with_hashes=False)
    whole = runs.join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select(
        "doc_id", "mark", "first", (F.col("windows") + (size - 1)).alias("n_words")
    )
    contested = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    windows = (
        kinds.join(contested, "anchor", "left_semi")
        .select("anchor", "n", "hashes", "at.*")
        .mapInArrow(_single_windows, "anchor long, window long, n long, doc_id long, mark long, first int")
    )
    counted = windows.groupBy("anchor", "window").agg(F.sum("n").alias("total")).where("total > 1")
    single = windows.where("n = 1").join(counted, ["anchor", "window"], "left_semi")
    return whole.unionByName(single.select("doc_id", "mark", "first", F.lit(size).alias("n_words")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffers(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        out: dict[str, list] = {name: [] for name in ("n_words", "n_removed", "kept_sha256", "kept_text")}
        for i, found in enumerate(spans):
            words = Words(raw, bounds[i : i + 2])
            n = len(words.starts)
            kept = np.ones(n, bool)
            if found:
                first, length = np.array([(s["first"], s["n_words"]) for s in found], np.int64).T
                for s, e in zip(*merged_spans(first, length), strict=True):
                    kept[s:e] = False
            data = words.data.tobytes()
            text = b" ".join([data[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)])
            out["n_words"].append(n)
            out["n_removed"].append(n - int(kept.sum()))
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            out["kept_text"].append(text.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept_text"], pa.string())],
            ["doc_id", *out],
        )


def remove_repeated_windows(
    docs: DataFrame, size: int = WINDOW, gram: int = GRAM, sketch_rows: int = SKETCH_ROWS, sketch_bits: int = SKETCH_BITS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    docs = marked(docs)
    spans = (
        repeated_spans(docs, size, gram, sketch_rows, sketch_bits)
        .groupBy("doc_id", "mark")
        .agg(F.collect_set(F.struct("first", "n_words")).alias("spans"))
    )
    left, right = docs.alias("d"), spans.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.mark") == F.col("s.mark"))
    return left.join(right, same, "left").select("d.doc_id", "d.text", "s.spans").mapInArrow(_cut, RESULT)


def op10_window_dedup(spark, folder: str) -> DataFrame:
    return remove_repeated_windows(read(spark, folder, "documents")).drop("kept_text")
