"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over one feature after the other, on counts per bin; their sum is
a lookup table per feature. Pairs of features whose binned residuals gain most get tables of their
own, boosted the same way. A score is the logistic function of one table cell per feature and pair,
added up for whole batches.

The model is fitted on at most ``max_rows`` labelled rows, the first by a hash of doc_id, and of
those on the first ``max_rows`` rows of different text by a hash of id, text and label (repeated rows
of a document are one), so the fit has a bound of its own whatever the corpus; every row is scored from its whole text. Nulls count as
empty texts, whose features are all zero. Labels that are null or of unknown documents are left out;
a document labelled twice counts twice; one class alone gives its share as constant score. Rows
without doc_id are scored and not held out. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.hashing import BYTE_CODES, BYTE_POWERS, SPACE, Spans, Words, row_chunks, text_buffers
from ledgerline.llm.tables import read, texts

MAX_ROWS = 20_000
BINS = 64
PAIR_BINS = 16
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
LEAVES = 4
RATE = 0.1
PENALTY = 1.0

FEATURES = [
    "log_words", "word_bytes", "distinct_words", "repeated_windows", "symbols", "bars", "exclamations", "capitals",
    "digits", "points", "high_bytes", "log_lines", "repeated_lines", "ended_lines",
]


def _class(chars: str) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(chars.encode())] = True
    return held


_CLASSES = {
    "symbols": _class("#*$%&<>=^~_\\{}@"),
    "bars": _class("|"),
    "exclamations": _class("!?"),
    "capitals": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _class("0123456789"),
    "points": _class(".,;:"),
    "high_bytes": np.arange(256) >= 128,
}
_ENDS = _class(".!?\"')")


def _distinct(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct values of each row."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=len(bounds) - 1)


def features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` per text of a chunk."""
    rows = bounds - bounds[0]
    words = Words(raw, bounds)
    data = words.data

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return sums[rows[1:]] - sums[rows[:-1]]

    share = lambda part, whole: part / np.maximum(whole, 1)
    solid = per_row(~SPACE[data])
    n_words = np.diff(words.bounds)
    windows, window_bounds = words.windows(5)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([rows[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, starts)])
    filled = ends > starts
    starts, ends = starts[filled], ends[filled]
    lines = Spans(BYTE_CODES[data], BYTE_POWERS).hash(starts, ends)
    line_bounds = np.searchsorted(starts, rows)
    n_lines = np.diff(line_bounds)
    closed = np.append(0, np.cumsum(_ENDS[data[ends - 1]] if len(ends) else []))
    out = {
        "log_words": np.log1p(n_words),
        "word_bytes": share(solid, n_words),
        "distinct_words": share(_distinct(words.hashes, words.bounds), n_words),
        "repeated_windows": 1 - share(_distinct(windows, window_bounds), np.diff(window_bounds)),
        "log_lines": np.log1p(n_lines),
        "repeated_lines": 1 - share(_distinct(lines, line_bounds), n_lines),
        "ended_lines": share(closed[line_bounds[1:]] - closed[line_bounds[:-1]], n_lines),
    } | {name: share(per_row(held[data]), solid) for name, held in _CLASSES.items()}
    out["repeated_windows"][np.diff(window_bounds) == 0] = 0
    out["repeated_lines"][n_lines == 0] = 0
    return np.column_stack([out[name] for name in FEATURES]).astype(np.float64)


@dataclass
class Model:
    """Lookup tables: cuts and values per feature, and per pair of features."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_cuts[f], x[:, f], side="right"), np.searchsorted(self.pair_cuts[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-total))


def _gain(g, h):
    return g * g / (h + PENALTY)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree of at most ``LEAVES`` leaves over binned gradients."""
    sums_g, sums_h = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None)
        for k, (a, b) in enumerate(leaves):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            left_g, left_h = sums_g[at] - sums_g[a], sums_h[at] - sums_h[a]
            all_g, all_h = sums_g[b] - sums_g[a], sums_h[b] - sums_h[a]
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            i = int(np.argmax(gains))
            if gains[i] > best[0]:
                best = (gains[i], (k, int(at[i])))
        if best[1] is None:
            break
        k, at = best[1]
        a, b = leaves.pop(k)
        leaves += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (sums_g[b] - sums_g[a]) / (sums_h[b] - sums_h[a] + PENALTY)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut of a pair's cells into four quarters."""

    def corners(x):
        sums = x.cumsum(axis=0).cumsum(axis=1)
        top, left, all_ = sums[:, -1:], sums[-1:, :], sums[-1, -1]
        return sums, top - sums, left - sums, all_ - top - left + sums

    parts = list(zip(corners(g), corners(h), strict=True))
    gains = sum(_gain(a, np.maximum(b, 0)) for a, b in parts)[:-1, :-1]
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    value = [a[i, j] / (max(b[i, j], 0) + PENALTY) for a, b in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gains[i, j] - _gain(g.sum(), h.sum())), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on rows ``x`` (features) with labels ``y`` (0 or 1)."""
    quantiles = lambda n: [np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1])) if len(column) else np.zeros(0) for column in x.T]
    model = Model(quantiles(BINS), [], quantiles(PAIR_BINS))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    share = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, at in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(at, g, n), np.bincount(at, h, n))
            model.tables[f] += step
            total += step[at]
    coarse = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.pair_cuts)]
    widths = [len(c) + 1 for c in model.pair_cuts]

    def cells(f, g_, grad, hess):
        at, shape = coarse[f] * widths[g_] + coarse[g_], (widths[f], widths[g_])
        n = widths[f] * widths[g_]
        return at, _quarters(np.bincount(at, grad, n).reshape(shape), np.bincount(at, hess, n).reshape(shape))

    grad, hess = slopes()
    ranked = sorted((-cells(f, g, grad, hess)[1][0], f, g) for f in range(x.shape[1]) for g in range(f + 1, x.shape[1]))
    model.pairs = [(f, g) for _, f, g in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((widths[f], widths[g])) for f, g in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (f, g) in enumerate(model.pairs):
            at, (_, values) = cells(f, g, *slopes())
            model.pair_tables[k] += RATE * values
            total += RATE * values.ravel()[at]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the rows of ``labels`` that are not held out, at most ``max_rows``."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = labelled.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_buffers(batch.column("text"))
            for a, z in row_chunks(bounds):
                rows = features(raw, bounds[a : z + 1])
                part = batch.slice(a, z - a).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(rows))], [*part.schema.names, "x"])

    # At most max_rows rows are broadcast, and as many rows of features come back: a document's rows
    # of one text are one row, which comes once a label of the sample.
    numbered = sample.groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("times"))
    found = texts(docs).join(F.broadcast(numbered), "doc_id").select("doc_id", "quality", "times", F.xxhash64("text").alias("mark"), "text")
    found = found.mapInArrow(run, "doc_id long, quality int, times long, mark long, x array<double>")
    once = found.groupBy("doc_id", "quality", "mark").agg(F.min("times").alias("times"), F.min("x").alias("x"))
    each = once.select("doc_id", "quality", "mark", "x", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("n"))
    place = F.xxhash64("doc_id", "mark", "quality", "n")
    rows = each.orderBy(place, "doc_id", "mark", "quality", "n").limit(max_rows).toArrow()
    x = np.array(rows.column("x").to_pylist()).reshape(-1, len(FEATURES))
    y = rows.column("quality").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y, rows.column("doc_id").to_numpy()))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_buffers(batch.column("text"))
            for a, z in row_chunks(bounds):
                found = held.value.scores(features(raw, bounds[a : z + 1]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), pa.array(found)], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def op9_quality_gam(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = train(docs, read(spark, folder, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
