"""Vector code compression: each part of a vector becomes the index of its codebook's nearest entry.

Components are whole numbers, ``floor(SCALE * x)``. A part's numbers fall into a coarse cell of a
grid; the cell's hash finds the entries of the codebook that may be nearest to something in the
cell. An entry is ruled out for the whole cell if its least distance to the box is above the largest
distance of another entry. Only the entries left are held against the part itself, exactly. Cells
are remembered per task, a fixed number a part; two cells of one hash are never mixed up, as the
cell's corner is remembered too.

Codebooks start as the parts of the first kept vectors by vec_id and are refined by rounds of
assignment and floored means. Sums are whole numbers, so results depend on no order. What reaches
the driver is a codebook: ``parts * entries`` rows of sums, however many vectors there are.

A null vector, or one with a null, NaN or infinite component, is dropped; so is one whose length is
no positive multiple of ``parts``, or is not that of the first kept vector. Components are held
within ``LIMIT`` on both sides, so that distances are exact in 64 bits (up to 2**9 components). Rows
without vec_id come last among the first vectors. Repeated rows count as often as they occur. With
fewer vectors than entries a codebook has as many entries as there are vectors; an empty table gives
no rows. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.hashing import mix
from ledgerline.llm.tables import read, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 26
#: Edge of a grid cell, in scaled units.
EDGE = 16
#: Cells that a task remembers for each part; the memory is started afresh when they are more.
CELLS = 1 << 13
#: Numbers that are compared at once.
WORK = 1 << 21


def whole_numbers(column: pa.Array, parts: int, length: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that hold a proper vector, and their scaled components."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bounds = np.append(0, np.cumsum(sizes))
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    proper = (sizes > 0) & (sizes % parts == 0) & (bad[bounds[1:]] == bad[bounds[:-1]])
    if length is not None:
        proper &= sizes == length
    rows = np.flatnonzero(proper)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.clip(np.floor(values * SCALE), -LIMIT, LIMIT)
    return rows, [scaled[bounds[r] : bounds[r + 1]].astype(np.int64) for r in rows]


class Memo:
    """The entries of one part's codebook that may be nearest, remembered by grid cell."""

    def __init__(self, book: np.ndarray, edge: int, cells: int):
        self.book, self.edge, self.cells = book, edge, cells
        self._clear()

    def _clear(self) -> None:
        self.places: dict[int, int] = {}
        self.corners = np.zeros((0, self.book.shape[1]), np.int64)
        self.open = np.zeros((0, len(self.book)), bool)

    def _undominated(self, corners: np.ndarray) -> np.ndarray:
        low = corners[:, None, :] * self.edge
        high = low + self.edge - 1
        book = self.book[None, :, :]
        least = np.square(np.clip(book, low, high) - book).sum(axis=2)
        most = np.square(np.maximum(np.abs(book - low), np.abs(book - high))).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def _open(self, corners: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Per cell (one of each hash) the entries that are not ruled out."""
        keys = hashes.tolist()
        if len(self.places) + len(keys) > self.cells:
            self._clear()
        place = np.array([self.places.get(k, -1) for k in keys], np.int64)
        known = place >= 0
        known[known] = (self.corners[place[known]] == corners[known]).all(axis=1)
        out = np.empty((len(keys), len(self.book)), bool)
        out[known] = self.open[place[known]]
        new = np.flatnonzero(~known)
        step = max(1, WORK // self.book.size)
        for a in range(0, len(new), step):
            out[new[a : a + step]] = self._undominated(corners[new[a : a + step]])
        fresh = new[place[new] < 0]  # a cell whose hash another one has is computed each time
        self.places.update((keys[i], len(self.corners) + k) for k, i in enumerate(fresh))
        self.corners = np.concatenate([self.corners, corners[fresh]])
        self.open = np.concatenate([self.open, out[fresh]])
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower) and its squared distance, a row of ``x`` each."""
        corners = np.floor_divide(x, self.edge)
        hashes = np.zeros(len(x), np.uint64)
        for column in corners.T:
            hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + column.view(np.uint64))
        distinct, first, cell = np.unique(hashes, return_index=True, return_inverse=True)
        open_ = self._open(corners[first], distinct)[cell]
        open_[(corners != corners[first][cell]).any(axis=1)] = True  # another cell of the same hash
        row, entry = np.nonzero(open_)
        distance = np.square(x[row] - self.book[entry]).sum(axis=1)
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(distance, heads)
        at = np.flatnonzero(distance == least[row])  # entries of a row stand in order: the first is the lowest
        at = at[np.append(True, row[at][1:] != row[at][:-1])]
        return entry[at], least


class Codebooks:
    """Codebooks of all parts: an array of part, entry, component."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.length = books.shape[0] * books.shape[2]

    def memos(self, edge: int, cells: int) -> list[Memo]:
        return [Memo(book, edge, cells) for book in self.books]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _coded(column: pa.Array, books: Codebooks, memos: list[Memo]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their parts, their codes and errors; a bounded number of rows at a time."""
    parts, entries, size = books.books.shape
    rows, vectors = whole_numbers(column, parts, books.length)
    step = max(1, WORK // (entries * size))
    for a in range(0, len(rows), step):
        x = np.stack(vectors[a : a + step]).reshape(-1, parts, size)
        found = [memo.nearest(x[:, p]) for p, memo in enumerate(memos)]
        codes = np.stack([c for c, _ in found], axis=1)
        yield rows[a : a + step], x, codes, np.sum([d for _, d in found], axis=0)


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """Codebooks of the first kept vectors; None if there are none."""

    def run(length: int | None):
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = whole_numbers(batch.column("vector"), parts, length)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(rows)), pa.array(found, pa.list_(pa.int64()))], ["vec_id", "numbers"]
                )

        numbers = vectors.select("vec_id", "vector").mapInArrow(kept, "vec_id long, numbers array<long>")
        return [r.numbers for r in numbers.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(entries).collect()]

    first = run(None)
    if len({len(x) for x in first}) > 1:
        first = run(len(first[0]))
    if not first:
        return None
    return Codebooks(np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2))


def refined(vectors: DataFrame, books: Codebooks, edge: int, cells: int) -> Codebooks:
    """Each entry becomes the floored mean of the parts nearest to it; an entry without parts stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, size = books.books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        memos = books.memos(edge, cells)
        total = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            for _, x, codes, _ in _coded(batch.column("vector"), books, memos):
                for p in range(parts):
                    np.add.at(total[p, :, size], codes[:, p], 1)
                    np.add.at(total[p], (codes[:, p], slice(0, size)), x[:, p])
        cells_of = np.flatnonzero(np.repeat(total[:, :, size].ravel() > 0, size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(cells_of), pa.array(total.ravel()[cells_of])], ["cell", "total"])

    found = vectors.select("vector").mapInArrow(sums, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total"))
    total = np.zeros(parts * entries * (size + 1), np.int64)
    for r in found.collect():  # one number per component of a codebook
        total[r.cell] = r.total
    total = total.reshape(parts, entries, size + 1)
    n = total[:, :, size:]
    return Codebooks(np.where(n > 0, np.floor_divide(total[:, :, :size], np.maximum(n, 1)), books.books))


def compress(
    table: DataFrame,
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    edge: int = EDGE,
    cells: int = CELLS,
) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (two hex digits a part), error for every kept row; and the codebooks."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    label = table.schema["label"].dataType.simpleString()
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).cast("array<double>").alias("vector"))
    schema = f"vec_id long, label {label}, code string, error long"
    books = first_codebooks(vectors, parts, entries)
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    for _ in range(rounds):
        books = refined(vectors, books, edge, cells)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        memos = books.memos(edge, cells)
        for batch in batches:
            for rows, _, codes, errors in _coded(batch.column("vector"), books, memos):
                at, digits = pa.array(rows), codes.astype(np.uint8).tobytes().hex()
                width = 2 * codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(at),
                        batch.column("label").take(at),
                        pa.array([digits[i : i + width] for i in range(0, len(digits), width)], pa.string()),
                        pa.array(errors),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return vectors.mapInArrow(run, schema), books


def decompress(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector that its code stands for: the entries' components, scaled back."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.books
        for batch in batches:
            index = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(batch.num_rows, len(held))
            found = held[np.arange(len(held)), index].reshape(batch.num_rows, -1) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(found), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def op11_vector_codes(spark, folder: str) -> DataFrame:
    coded, books = compress(read(spark, folder, "embeddings"))
    coded = stored(coded)
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    return coded.join(per_label, coded["label"].eqNullSafe(per_label["same"])).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256")
    )
