"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its bytes, A-Z in lower case, and an end byte that no text holds. Every bit is predicted
from several contexts: the last bytes, a few lengths, and the word so far. A context and the bits of
the byte seen so far are hashed into a table of fixed size that counts zeros and ones over all
training texts. The predictors' log odds are added up with weights from a gate (place of the bit,
and which of the two longest contexts were ever seen). Several sharpened and flattened variants of
the weights bet on a text; after every block of bytes each is trusted by what it has given the text
so far, so a text refines its own mix as it is read.

Counts are whole numbers, so the table depends on no order. Weights are fitted by a Newton step over
all training texts, each half of the texts on the counts of the other half (equal texts fall into
one half), from sums of fixed size; they are rounded, so the order of the sums does not show. Within
a stretch equal contexts before equal bytes are looked up once, which changes no result. Those of the
training texts are gathered once, with how often they occur, and written; counts and sums read that.

The unigram base counts all words of the training texts. A text finds the most frequent words, a
fixed number, in its task, and the others by a join in which no word is hot.

Nulls count as empty texts: one end token, one end byte. Long texts are worked through in pieces of
fixed size. Rows without doc_id are no held-out rows. Repeated rows are learned as often as they
occur, and scored alike. Without training rows every bit has probability 1/2 and every token 1
(nothing is known of any). Empty tables give no rows; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.hashing import LOWER, Words, mix, row_chunks, text_buffers
from ledgerline.llm.sketch import packed, unpacked
from ledgerline.llm.tables import read, stored
from ledgerline.llm.tallies import Head, counted, head_and_tail

#: Bytes before a bit's byte that are a context, shortest first; the word so far comes after them.
ORDERS = (2, 3, 5)
#: The word so far counts at most so many bytes, its last ones.
REACH = 8
BITS = 22
SLICE_BITS = 15
#: Added to both counts of a cell.
SMALL = 0.4
#: Log odds are held as whole numbers of this part, up to ``MOST``.
PART, MOST = 1 / 512, 12.0
#: Newton steps of the weights, what they start from, and a penalty on leaving it.
STEPS, START, PENALTY = 1, (0.15, 0.4, 0.4, 0.15), 4.0
#: What the weights are multiplied by in the variants that bet on a text, and how fast trust fades.
VARIANTS, SHARE = (0.75, 1.0, 1.3), 0.02
#: Bytes between two refinements of a text's mix.
BLOCK = 256
PIECE = 1 << 21
#: Distinct contexts that are looked up at once.
SLICE = 1 << 12
#: Distinct contexts that a task holds.
HELD = 1 << 20
#: Distinct contexts in a row of those written.
PORTION = 1 << 16
FREQUENT = 1 << 19
END, END_KEY = 255, 0

CONTEXTS = "before binary, word binary, codes binary, times binary"

_PREDICTORS = len(ORDERS) + 1
_GATES = 8 * 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODDS = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: Masks for the last bytes of a number, and what stands between words: ASCII but letters and digits.
_LAST = np.array([2**64 - 2 ** (64 - 8 * n) for n in range(REACH + 1)], np.uint64)
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_REACHES = np.arange(REACH + 1, dtype=np.uint64) * _ODD
_BYTES = np.arange(256, dtype=np.uint64) * _ODDS[0]


@dataclass
class Stretch:
    """Consecutive bytes of texts: bytes before them that count as context, and where texts begin."""

    codes: np.ndarray
    starts: np.ndarray
    back: int
    #: Row and own bytes of each text, in order, and how many of its bytes came in earlier stretches.
    rows: np.ndarray
    sizes: np.ndarray
    earlier: int

    @classmethod
    def of_texts(cls, raw: np.ndarray, bounds: np.ndarray, first: int) -> Stretch:
        """Whole texts, an end after each."""
        lengths = np.diff(bounds)
        starts = bounds[:-1] - bounds[0] + np.arange(len(lengths))
        codes = np.full(int(lengths.sum()) + len(lengths), END, np.uint8)
        inner = np.ones(len(codes), bool)
        inner[starts + lengths] = False
        codes[inner] = LOWER[raw[bounds[0] : bounds[-1]]]
        return cls(codes, starts, 0, np.arange(len(lengths)) + first, lengths + 1, 0)

    @classmethod
    def of_piece(cls, text: np.ndarray, start: int, row: int) -> Stretch:
        """A piece of one long text, after the bytes that its contexts reach back to."""
        back, stop = min(start, REACH), min(len(text), start + PIECE)
        codes = LOWER[text[start - back : stop]]
        if stop < start + PIECE:
            codes = np.append(codes, np.uint8(END))
        starts = np.zeros(0 if start else 1, np.int64)
        return cls(codes, starts, back, np.array([row]), np.array([len(codes) - back]), start)


def stretches(batch: pa.RecordBatch) -> Iterator[Stretch]:
    """All texts of a batch in stretches of bounded size; the pieces of a text come in order."""
    raw, bounds = text_buffers(batch.column("text"))
    for a, z in row_chunks(bounds, PIECE):
        if bounds[z] - bounds[a] < PIECE:
            yield Stretch.of_texts(raw, bounds[a : z + 1], a)
            continue
        for row in range(a, z):
            text = raw[bounds[row] : bounds[row + 1]]
            for start in range(0, len(text) + 1, PIECE):
                yield Stretch.of_piece(text, start, row)


def _since(marks: np.ndarray, size: int) -> np.ndarray:
    """Bytes since the last mark, at most ``REACH``, for ``size`` bytes."""
    out = np.full(size + REACH, REACH, np.uint8)
    for n in range(REACH - 1, -1, -1):
        out[marks + n] = n
    return out[:size]


class Contexts:
    """The distinct contexts and bytes of a stretch, and the own bytes that are each of them, side by side."""

    def __init__(self, stretch: Stretch, bits: int):
        codes = stretch.codes
        padded = np.concatenate([np.zeros(REACH, np.uint8), codes])
        # The bytes before each byte as one number, the nearest highest; none from before its text.
        before = np.ndarray(len(codes), "<u8", padded, strides=(1,)) & _LAST.take(_since(stretch.starts, len(codes)))
        word = _since(np.concatenate([stretch.starts, np.flatnonzero(_APART.take(codes[:-1])) + 1]), len(codes))
        reach = np.maximum(word, max(ORDERS))
        whole = before & _LAST.take(reach)
        whole ^= _REACHES.take(reach)
        whole += _BYTES.take(codes)
        hashes = mix(whole)[stretch.back :]
        self.places, self.heads = _runs(hashes)
        at = self.places[self.heads]
        self.hashes = hashes[at]
        at += stretch.back
        self.before, self.word, self.codes = before[at], word[at], codes[at]
        self.bits = bits

    def __len__(self) -> int:
        return len(self.codes)

    def parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Slices of the distinct ones: which, cell by bit and predictor, the bits."""
        for first in range(0, len(self), SLICE):
            at = slice(first, first + SLICE)
            before, found = self.before[at], self.codes[at].astype(np.uint64)
            seeds = np.stack([*((before & _LAST[i]) + np.uint64(i) for i in ORDERS), (before & _LAST[self.word[at]]) + np.uint64(REACH + 1)], axis=1)
            nodes = (found[:, None] | np.uint64(256)) >> np.arange(8, 0, -1, dtype=np.uint64)  # a one, and the bits before
            nodes *= _ODDS[0]
            cells = mix(seeds)[:, None, :] + nodes[:, :, None]
            cells *= _ODDS[1]
            cells >>= np.uint64(64 - self.bits)
            yield at, cells.view(np.int64), np.unpackbits(self.codes[at][:, None], axis=1)


class Gathered(Contexts):
    """Distinct contexts and bytes of many stretches, and how often each half has them."""

    def __init__(self, bits: int):
        self.hashes, self.before = np.zeros((2, 0), np.uint64)
        self.word, self.codes = np.zeros((2, 0), np.uint8)
        self.times = np.zeros((2, 0), np.int64)
        self.bits = bits
        self.pending: list[Contexts] = []

    def add(self, stretch: Stretch, half: np.ndarray) -> bool:
        """Add a stretch; whether there are enough distinct ones to be worked off."""
        found = Contexts(stretch, self.bits)
        of_one = np.repeat(half[stretch.rows].astype(np.uint8), stretch.sizes).take(found.places)
        of_one = np.add.reduceat(of_one, found.heads, dtype=np.int64)
        found.times = np.stack([np.diff(found.heads, append=len(found.places)) - of_one, of_one])
        found.places = found.heads = None
        self.pending.append(found)
        if sum(map(len, self.pending)) > max(HELD // 4, len(self)):
            self.fold()
        return len(self) > HELD

    def fold(self) -> None:
        held = [self, *self.pending]
        hashes, before, word, codes = (np.concatenate([getattr(x, n) for x in held]) for n in ("hashes", "before", "word", "codes"))
        times = np.concatenate([x.times for x in held], axis=1)
        places, heads = _runs(hashes)
        first = places[heads]
        self.hashes, self.before, self.word, self.codes = hashes[first], before[first], word[first], codes[first]
        self.times = np.stack([np.add.reduceat(t.take(places), heads) if len(heads) else t for t in times])
        self.pending = []


def gathered(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[Gathered]:
    """The distinct contexts and bytes of a partition, in portions of bounded size."""
    found = Gathered(bits)
    for batch in batches:
        half = batch.column("half").to_numpy()
        for stretch in stretches(batch):
            if found.add(stretch, half):
                yield found
                found = Gathered(bits)
    found.fold()
    yield found


def contexts_of(training: DataFrame, bits: int) -> DataFrame:
    """The distinct contexts and bytes of all training texts, portion by portion, and their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in gathered(batches, bits):
            for first in range(0, len(found), PORTION):
                at = slice(first, first + PORTION)
                held = found.before[at], found.word[at], found.codes[at], found.times[:, at].ravel()
                yield pa.RecordBatch.from_arrays([pa.array([packed(x)]) for x in held], ["before", "word", "codes", "times"])

    return training.mapInArrow(run, CONTEXTS)


def portions(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[Gathered]:
    """What ``contexts_of`` has gathered."""
    for batch in batches:
        for before, word, codes, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = Gathered(bits)
            found.before, found.word, found.codes = unpacked(before, np.uint64), unpacked(word, np.uint8), unpacked(codes, np.uint8)
            found.times = unpacked(times, np.int64).reshape(2, -1)
            yield found


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes, equal ones side by side, and where each run of equal ones begins.

    Places are sorted along with the upper bits of the hashes; hashes that agree in those are
    compared in the others too. Equal ones might stay apart where others lie between, which only
    costs time.
    """
    low = np.uint64((1 << (len(hashes) - 1).bit_length()) - 1) if len(hashes) > 1 else np.uint64(0)
    kept = (hashes & low).astype(np.uint32 if low < 1 << 32 else np.uint64)
    sorted_ = np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64))
    places = (sorted_ & low).view(np.int64)
    kept = kept.take(places)
    new = np.ones(len(hashes), bool)
    new[1:] = ((sorted_[1:] ^ sorted_[:-1]) > low) | (kept[1:] != kept[:-1])
    return places, np.flatnonzero(new)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Whole parts of log odds from counts of zeros and ones; 0 means never seen."""
    zeros, ones = counts[..., 0].astype(np.float64), counts[..., 1].astype(np.float64)
    held = np.clip(np.log((ones + SMALL) / (zeros + SMALL)), -MOST, MOST) / PART
    parts = np.where(held < 0, np.minimum(np.rint(held), -1), np.maximum(np.rint(held), 1))
    return np.where(zeros + ones > 0, parts, 0).astype(np.int16)


def tables(training: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tables_of`` the contexts of training texts."""
    return tables_of(contexts_of(training, bits), bits)


def tables_of(contexts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds per cell from the counts of half 0, of half 1 and of all training texts.

    Tasks send the cells they have filled, compressed, by slices; what reaches the driver are three
    tables of ``2**bits`` cells.
    """
    width = 1 << min(bits, SLICE_BITS)
    slices = (1 << bits) // width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(4 << bits, np.int32)
        for found in portions(batches, bits):
            for at, cells, ones in found.parts():
                cells *= 4
                cells += ones[:, :, None]
                for h in range(2):  # counts of a cell lie side by side
                    times = found.times[h, at]
                    some = np.flatnonzero(times)
                    np.add.at(counts, (cells[some] + 2 * h).ravel(), np.repeat(times[some].astype(np.int32), 8 * _PREDICTORS))
        for k in range(slices):
            part = counts[4 * k * width : 4 * (k + 1) * width]
            filled = np.flatnonzero(part)
            if len(filled):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([packed(np.diff(filled, prepend=0).astype(np.uint32))]), pa.array([packed(part[filled])])],
                    ["slice", "cells", "counts"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault(k, np.zeros(4 * width, np.int64))
                held[np.cumsum(unpacked(at, np.uint32), dtype=np.int64)] += unpacked(n, np.int32)
        for k, held in sums.items():
            halves = held.reshape(width, 2, 2)
            odds = np.stack([log_odds(halves[:, 0]), log_odds(halves[:, 1]), log_odds(halves.sum(axis=1))])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(odds.ravel())])], ["slice", "odds"])

    parts = contexts.mapInArrow(partial, "slice int, cells binary, counts binary").repartition(slices, "slice").mapInArrow(total, "slice int, odds binary")
    out = np.zeros((3, slices, width), np.int16)
    for r in parts.collect():  # a row a slice
        out[:, r["slice"]] = unpacked(r.odds, np.int16).reshape(3, width)
    return tuple(out.reshape(3, -1))


def inputs(cells: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of all predictors, and the gate, for every bit."""
    parts = table.take(cells, mode="clip")
    gates = np.repeat(np.arange(0, _GATES, 4, dtype=np.uint8)[None], len(parts), axis=0)
    gates += 2 * (parts[:, :, -2] != 0).view(np.uint8) + (parts[:, :, -1] != 0).view(np.uint8)
    return parts * np.float32(PART), gates


def _add_sums(total: np.ndarray, times: np.ndarray, ones: np.ndarray, x: np.ndarray, gates: np.ndarray, weights: np.ndarray) -> None:
    """Add slope and bend of the log probability by the weights, for every gate."""
    k = x.shape[2]
    gates = gates.ravel()
    order, sizes = np.argsort(gates, kind="stable"), np.bincount(gates, minlength=_GATES)
    x = x.reshape(-1, k).take(order, axis=0).astype(np.float64)
    p = 1 / (1 + np.exp(-sum(x[:, i] * np.repeat(weights[:, i], sizes) for i in range(k))))
    n = np.repeat(times, 8).take(order)
    parts = np.empty((k + 1, len(p)))
    parts[0] = n * (ones.ravel().take(order) - p)
    np.multiply(x.T, n * (p * (1 - p)), out=parts[1:])
    cuts = np.append(0, np.cumsum(sizes))
    for g in np.flatnonzero(sizes):
        a, z = cuts[g], cuts[g + 1]
        total[g] += (parts[:, a:z] @ x[a:z]).ravel()


def fitted(contexts: DataFrame, halves: tuple[np.ndarray, np.ndarray], bits: int, steps: int) -> np.ndarray:
    """Weights per gate and predictor: Newton steps on sums over the contexts of all training texts."""
    context = contexts.sparkSession.sparkContext
    shared = context.broadcast(halves)
    weights = np.tile(np.array(START), (_GATES, 1))
    k = _PREDICTORS

    for _ in range(steps):
        now = context.broadcast(weights)

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((_GATES, k + k * k))
            for found in portions(batches, bits):
                for at, cells, ones in found.parts():
                    for h in range(2):
                        times = found.times[h, at]
                        some = np.flatnonzero(times)
                        _add_sums(total, times[some], ones[some], *inputs(cells[some], shared.value[1 - h]), now.value)
            cells = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], ["cell", "value"])

        found = contexts.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        total = np.zeros(_GATES * (k + k * k))
        for r in found.collect():  # a fixed number of sums
            total[r.cell] = r.value
        total = total.reshape(_GATES, -1)
        for g in range(_GATES):
            bend = total[g, k:].reshape(k, k) + PENALTY * np.eye(k)
            weights[g] = weights[g] + np.linalg.solve(bend, total[g, :k] - PENALTY * (weights[g] - START))
        weights = np.round(weights, 5)
    return weights


class Scorer:
    """Scores texts with a table and weights; remembers a long text's trust between its pieces."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bits: int):
        self.table, self.weights, self.bits = table, weights.astype(np.float32), bits
        self.left: tuple[int, np.ndarray] | None = None

    def losses(self, stretch: Stretch) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a stretch and minus the natural logarithm of the probability of their own bytes."""
        found = Contexts(stretch, self.bits)
        each = np.empty((len(VARIANTS), len(found)))
        for at, cells, ones in found.parts():
            x, gates = inputs(cells, self.table)
            gates = gates.astype(np.intp)
            by = [x[:, :, k] * w.take(gates) for k, w in enumerate(self.weights.T)]
            while len(by) > 1:  # two by two
                by = [sum(by[i : i + 2]) for i in range(0, len(by), 2)]
            mixed = by[0]
            against = np.where(ones == 1, -mixed, mixed)  # log odds of the bit that did not come
            for i, v in enumerate(VARIANTS):
                loss = np.log(1 + np.exp(np.minimum(against * np.float32(v), 60)))
                each[i, at] = np.ascontiguousarray(loss.T).sum(axis=0, dtype=np.float64)  # bit after bit, in every slice
        # Loss of every variant on every block of every text.
        n_blocks = -(-stretch.sizes // BLOCK)
        ends = np.cumsum(n_blocks)
        text = np.repeat(np.arange(len(n_blocks)), n_blocks)
        number = np.arange(len(text)) - (ends - n_blocks)[text]
        begin = (np.cumsum(stretch.sizes) - stretch.sizes)[text] + number * BLOCK
        block = np.repeat(np.arange(len(text), dtype=np.int32), np.diff(begin, append=len(found.places))).take(found.places).astype(np.intp)
        runs = np.diff(found.heads, append=len(found.places))
        blocks = np.stack([np.bincount(block, np.repeat(loss, runs), len(text)) for loss in each], axis=1)
        # The texts side by side, a block each: those with most blocks first, so that the rest drop out.
        order = np.argsort(-n_blocks, kind="stable")
        first, counts = (ends - n_blocks)[order], n_blocks[order]
        trust = np.full((len(order), len(VARIANTS)), 1 / len(VARIANTS))
        if self.left and stretch.earlier and self.left[0] == stretch.rows[0]:
            trust[0] = self.left[1]
        total = np.zeros(len(order))
        for n in range(int(counts[0])):
            here = int(np.searchsorted(-counts, -n))
            loss = blocks[first[:here] + n]
            least = loss.min(axis=1, keepdims=True)
            given = trust[:here] * np.exp(least - loss)
            whole = given.sum(axis=1, keepdims=True)
            total[:here] += least[:, 0] - np.log(whole[:, 0])
            trust[:here] = (1 - SHARE) * given / whole + SHARE / len(VARIANTS)
        self.left = int(stretch.rows[-1]), trust[int(np.flatnonzero(order == len(order) - 1)[0])]
        return stretch.rows[order], total


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out and the half that a training text belongs to."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), held.alias("held_out"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"))


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, all tokens, and the place of each row's tokens, chunk by chunk."""
    raw, bounds = text_buffers(batch.column("text"))
    for a, z in row_chunks(bounds):
        words = Words(raw, bounds[a : z + 1], lower=True)
        stops = words.bounds[1:] + np.arange(1, z - a + 1)
        keys = np.full(len(words.hashes) + z - a, END_KEY, np.int64)
        inner = np.ones(len(keys), bool)
        inner[stops - 1] = False
        keys[inner] = words.hashes.view(np.int64)
        yield a, keys, np.append(0, stops)


def token_counts(rows: DataFrame) -> DataFrame:
    """key, n (in training texts) and n_all (in all texts) of every token."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        learned = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for a, keys, stops in _tokens(batch):
            of_training = np.repeat(learned[a : a + len(stops) - 1], np.diff(stops))
            for n, kept in ((1, of_training), (0, ~of_training)):
                distinct, times = np.unique(keys[kept], return_counts=True)
                yield distinct, np.stack([n * times, times], axis=1)

    return counted(rows.select("text", "held_out"), found, ["n", "n_all"])


@dataclass
class Model:
    """All that a task needs to score texts."""

    table: np.ndarray
    weights: np.ndarray
    bits: int
    head: Head
    whole: float


def scores(docs: DataFrame, bits: int = BITS, steps: int = STEPS, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes, bits_per_byte. Scores are log10 probabilities; n_bytes has the end byte."""
    context = docs.sparkSession.sparkContext
    rows = split(docs)
    counts = stored(token_counts(rows))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    whole = sums.n + 0.5 * (sums.distinct + 1)
    head, rare = head_and_tail(counts, "n_all", frequent)
    training = rows.where(~F.col("held_out")).select("text", "half")
    contexts = stored(contexts_of(training, bits))
    *halves, table = tables_of(contexts, bits)
    shared = context.broadcast(Model(table, fitted(contexts, tuple(halves), bits, steps), bits, head, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scorer = Scorer(model.table, model.weights, model.bits)
            loss, n_bytes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for stretch in stretches(batch):
                found, lost = scorer.losses(stretch)
                np.add.at(loss, found, lost)
                np.add.at(n_bytes, stretch.rows, stretch.sizes)
            n_tokens, n_known = np.zeros((2, batch.num_rows), np.int64)
            base = np.zeros(batch.num_rows)
            others = []
            for a, keys, stops in _tokens(batch):
                z, heads = a + len(stops) - 1, stops[:-1]
                places, runs = _runs(keys.view(np.uint64))  # a word is looked up once
                held, at = model.head.find(keys[places[runs]])
                c = np.append(model.head.columns["n"], 0)[np.where(held, at, -1)]
                which = np.empty(len(keys), np.int64)
                which[places] = np.repeat(np.arange(len(runs)), np.diff(runs, append=len(keys)))
                n_tokens[a:z] = np.diff(stops)
                n_known[a:z] = np.add.reduceat((c > 0).astype(np.int64).take(which), heads)
                base[a:z] = np.add.reduceat(np.where(held, np.log10((c + 0.5) / model.whole), 0.0).take(which), heads)
                held = held.take(which)
                left = np.append(0, np.cumsum(~held))[stops]
                others.append(pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(keys[~held])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens), pa.array(n_known), pa.array(base),
                    pa.array(-loss / math.log(10)), pa.array(n_bytes), pa.array(loss / math.log(2) / n_bytes),
                    pa.concat_arrays(others) if others else pa.array([], pa.list_(pa.int64())),
                ],
                ["doc_id", "held_out", "n_tokens", "known_held", "base_held", "score", "n_bytes", "bits_per_byte", "others"],
            )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, known_held long, base_held double, score double,"
        " n_bytes long, bits_per_byte double, others array<long>"
    )
    scored = stored(rows.select("doc_id", "text", "held_out").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    tail = (
        scored.select("row", F.explode("others").alias("key"))
        .join(rare.withColumnRenamed("n", "c"), "key")
        .groupBy("row")
        .agg(
            F.count_if(F.col("c") > 0).alias("known_joined"),
            F.sum(F.log10((F.col("c") + 0.5) / whole)).alias("base_joined"),
        )
    )
    none = F.lit(0)
    return scored.drop("others").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known_held") + F.coalesce("known_joined", none)).alias("n_known"),
        F.lit(sums.n).alias("train_tokens"), (F.col("base_held") + F.coalesce("base_joined", none.cast("double"))).alias("base_score"),
        "score", "n_bytes", "bits_per_byte",
    )


def op12_context_mixing(spark, folder: str) -> DataFrame:
    return scores(read(spark, folder, "documents"))
