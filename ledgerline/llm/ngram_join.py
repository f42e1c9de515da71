"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct word shingles. Documents with equal sets are one class. The
shingles of a set are hashed into groups; the group counts make a point, and two sets share at most
the sum of the smaller counts. An R-tree of such points rules out whole boxes by that bound.

Points meet under the rare shingles that two sets above the threshold must share: of every set in
one order of all shingles, the first ``n - ceil(t * n) + 1``. The order puts first what a merged
sketch of fixed size takes for unique in the corpus, and last what it takes for the most common; a
bad estimate costs time, never a link. Only components are asked for, so:

1. each point is held against the leader of the shingle it shares, pairs under the bound go, the
   rest is verified on the sets, and components are formed;
2. where the points of a shingle lie in several components, each point is held against the leaders
   of a few small random parts of its shingles, and components are formed again;
3. under every shingle whose points still lie in several components, the points outside the
   leader's component search R-trees of blocks of all its points; pairs within one component are
   not looked at, pairs that met under a shingle shortly before are left to that one, the others
   that pass the bound are verified.

Before sets are moved for a check, pairs are held against a second bound: bits that tell of which
cells a set holds an odd number. Sets differ by at least as many shingles as their bits do, and the
bits grow with the set, so few pairs but the linked ones are left, and only the sets of those move.

Shingles that one row has alone meet nobody and are left out; of shingles that the very same points
share, one is kept (points are told by count, ends and a 64-bit hash of all).

Every linked pair shares a shingle of step 3 or lies in one component already, so no link between
components is lost, while a third of all rows being near copies of one text costs a few pairs a row.

Texts without words and nulls have no shingles and are linked with nothing; texts of fewer words
than a shingle are one shingle. Repeated rows are linked. Rows without doc_id take part but never
name a component that has ids. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.hashing import WORD_POWERS, Spans, Words, mix, row_chunks, text_buffers
from ledgerline.llm.sketch import Cells, Commonness, merged
from ledgerline.llm.tables import read, stored
from ledgerline.llm.window_dedup import as_longs, marked

SHINGLE = 5
PERCENT = 80
GROUP_BITS = 7
#: Cells of the sketch that tells unique and common shingles; it follows the half of them with an even hash.
ORDER_BITS = 28
FILTER_BITS = 26
#: In step 2: shingles a point, and points a part; smaller groups were one part in step 1 already.
TRIES = 16
PART = 8
#: Rows whose sets or vectors are unpacked at once.
ROWS = 256
LEAF = 32
BLOCK = 4096
#: Shingles before the one that a pair meets under, of which it must not share any.
EARLIER = 4
#: Places in the order of shingles by how common the sketch takes them for.
PLACES = np.array([0, 1, 2, 4], np.int8)
#: Cells a shingle, at least, of the bits of a set.
SPREAD = 4

MEMBER = "doc_id long, mark long, n_shingles long, digest long"
KEY = "key long, digest long"
POINT = "digest long, n int, counts binary, odd binary, shingles binary"


def shingle_rows(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row offsets and the sorted distinct shingle hashes of the rows from there on, chunk by chunk."""
    raw, bounds = text_buffers(batch.column("text"))
    for a, z in row_chunks(bounds):
        words = Words(raw, bounds[a : z + 1], lower=True)
        hashes, offsets = words.windows(size)
        sets = [np.unique(hashes[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        lengths = np.diff(words.bounds)
        short = np.flatnonzero((lengths > 0) & (lengths < size))
        whole = Spans(words.hashes, WORD_POWERS).hash(words.bounds[short], words.bounds[short + 1])
        for row, h in zip(short, whole, strict=True):
            sets[row] = np.array([h], np.uint64)
        yield a, sets


def digest_of(shingles: np.ndarray) -> np.uint64:
    total = np.add.reduce(mix(shingles), dtype=np.uint64) if len(shingles) else np.uint64(0)
    return mix(np.array([total], np.uint64) + np.uint64(len(shingles)))[0]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def members(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark, n_shingles and the digest of its set for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_rows(batch, size):
                part = batch.slice(a, len(sets))
                digests = np.array([digest_of(s) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), as_longs(digests)],
                    ["doc_id", "mark", "n_shingles", "digest"],
                )

    return docs.mapInArrow(run, MEMBER)


def prefix_keys(docs: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """(key, digest): the rare shingles under which a set meets others; those of one row meet none."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, sets in shingle_rows(batch, size):
            found = np.concatenate(sets)
            yield found[found & np.uint64(1) == 0]

    common = docs.sparkSession.sparkContext.broadcast(Commonness.of(docs.select("text"), hashes, bits))

    def order(shingles: np.ndarray) -> np.ndarray:
        """0: followed and unique so far as the sketch tells, 1 and 2: in few texts and in more,
        3: not followed, 4: in most texts of all."""
        place = np.full(len(shingles), 3, np.int8)
        even = np.flatnonzero(shingles & np.uint64(1) == 0)
        place[even] = PLACES[common.value(shingles[even])]
        return place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_rows(batch, size):
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                place = order(np.concatenate(sets))
                keys, at = [], 0
                for s in sets:
                    own = place[at : at + len(s)]
                    rare = np.argsort(own, kind="stable")[: prefix_length(len(s), percent)]  # sets are sorted: ties go by hash
                    keys.append(s[rare[own[rare] > 0]])  # the sketch never takes for unique what two rows have
                    at += len(s)
                digests = np.repeat(np.array([digest_of(s) for s in sets], np.uint64), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([as_longs(np.concatenate(keys)), as_longs(digests)], ["key", "digest"])

    return docs.select("text").mapInArrow(run, KEY)


def odd_cells(shingles: np.ndarray) -> bytes:
    """A bit for every cell: does it hold an odd number of the shingles? Their number is a power of two."""
    cells = max(64, 1 << (SPREAD * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles >> np.uint64(16) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Shingles that are in one of two sets only, at least, by their odd cells."""
    x, y = (np.frombuffer(v, np.uint64) for v in (x, y))
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)  # cells are low bits of a hash: larger bits fold
    return int(np.bitwise_count(x ^ y).sum())


def points(docs: DataFrame, wanted: DataFrame, size: int, group_bits: int, filter_bits: int) -> DataFrame:
    """Sets and count vectors of the classes in ``wanted`` (digest), one row a class.

    A filter of fixed size keeps most other sets from being moved; the join decides.
    """

    def digests(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column("digest").to_numpy(zero_copy_only=False).view(np.uint64)

    present = merged(wanted, digests, 1, filter_bits, finish=lambda counts: np.packbits(counts > 0, bitorder="little"))
    maybe = docs.sparkSession.sparkContext.broadcast(present[0])
    cells, groups = Cells(1, filter_bits), 1 << group_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_rows(batch, size):
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                found = np.array([digest_of(s) for s in sets], np.uint64)
                at = cells.of(found, 0)
                kept = np.flatnonzero(maybe.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                counts = [np.bincount((sets[i] >> np.uint64(64 - group_bits)).astype(np.int64), minlength=groups) for i in kept]
                yield pa.RecordBatch.from_arrays(
                    [
                        as_longs(found[kept]),
                        pa.array([len(sets[i]) for i in kept], pa.int32()),
                        pa.array([_packed_counts(c) for c in counts], pa.binary()),
                        pa.array([odd_cells(sets[i]) for i in kept], pa.binary()),
                        pa.array([sets[i].tobytes() for i in kept], pa.binary()),
                    ],
                    ["digest", "n", "counts", "odd", "shingles"],
                )

    found = docs.select("text").mapInArrow(run, POINT)
    one = found.groupBy("digest").agg(*[F.min(c).alias(c) for c in ("n", "counts", "odd", "shingles")])
    return one.join(wanted, "digest", "left_semi")


def may_link(shared: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether ``shared`` common shingles of two sets of ``total`` shingles together reach the threshold."""
    return (100 + percent) * shared.astype(np.int64) >= percent * total


class CountTree:
    """An R-tree of count vectors, packed by halving the widest coordinate or the sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        # What a query has above the largest count here is never shared.
        self.most = int(counts.max(initial=0))
        self.kind = np.uint8 if self.most < 256 else np.int64
        self.counts, self.sizes = counts.astype(self.kind), sizes
        self.root = self._pack(np.arange(len(sizes)), leaf)

    def _pack(self, rows: np.ndarray, leaf: int):
        held, sizes = self.counts[rows], self.sizes[rows]
        upper = held.max(axis=0)
        box = (upper, int(sizes.min()), int(sizes.max()))
        if len(rows) <= leaf:
            return box, rows, None
        spread = upper - held.min(axis=0)
        widest = int(np.argmax(spread))
        by = sizes if box[2] - box[1] > spread[widest] else held[:, widest]
        order, half = rows[np.argsort(by, kind="stable")], len(rows) // 2
        return box, None, (self._pack(order[:half], leaf), self._pack(order[half:], leaf))

    def search(self, counts: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and point whose summed coordinate minima allow the threshold."""
        counts = np.minimum(counts, self.most).astype(self.kind)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        open_ = [(self.root, np.arange(len(sizes)))]

        def near(queries: np.ndarray, upper: np.ndarray, least: int, largest: int) -> np.ndarray:
            """Those that may link; two sets share no more than the smaller one has, which is told first."""
            own = sizes[queries]
            queries = queries[may_link(np.minimum(own, largest), own + least, percent)]
            shared = np.minimum(counts[queries], upper).sum(axis=1, dtype=np.int64)
            return queries[may_link(shared, sizes[queries] + least, percent)]

        while open_:
            (box, rows, below), queries = open_.pop()
            queries = near(queries, *box)
            if not len(queries):
                continue
            if below:
                open_ += [(below[0], queries), (below[1], queries)]
                continue
            for row in rows:
                passed = near(queries, self.counts[row], self.sizes[row], self.sizes[row])
                pairs.append((passed, np.full(len(passed), row)))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def _packed_counts(counts: np.ndarray) -> bytes:
    """The counts of a vector in a byte each, and what is above in three more where any count needs it."""
    low = counts.astype(np.uint8).tobytes()
    high = (counts >> 8).astype(np.uint32)
    return low + (high.tobytes() if high.any() else b"")


def _vectors(column: pa.Array) -> np.ndarray:
    cells = column.to_pylist()
    width = next((len(c) if len(c) & (len(c) - 1) == 0 else len(c) // 5 for c in cells), 1)
    out = np.frombuffer(b"".join(c[:width] for c in cells), np.uint8).astype(np.int64).reshape(len(cells), width)
    for i, c in enumerate(cells):
        if len(c) > width:
            out[i] += np.frombuffer(c[width:], np.uint32).astype(np.int64) << 8
    return out


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _earlier(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of at most ``EARLIER`` keys side by side, and which places are taken."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    taken = np.arange(EARLIER) < sizes[:, None]
    out = np.zeros(taken.shape, np.int64)
    out[taken] = column.flatten().to_numpy()
    return out, taken


def met_before(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], q: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether rows ``q`` of ``a`` and ``row`` of ``b`` share one of their earlier keys."""
    out = np.zeros(len(q), bool)
    for i in range(EARLIER):
        key, taken = a[0][q, i], a[1][q, i]
        for j in range(EARLIER):
            out |= (key == b[0][row, j]) & taken & b[1][row, j]
    return out


def tree_join(percent: int, leaf: int):
    """Candidate pairs from rows sorted by key, block and role (points before probes).

    A pair meets under all shingles that both sets have here. It is given under the first of them
    and under those where none of the few before, of either set, is shared.
    """
    names = ("key", "block", "probe", "digest", "component", "n")

    def held(batch: pa.RecordBatch):
        return [batch.column(c).to_numpy(zero_copy_only=False) for c in names], _vectors(batch.column("counts")), _earlier(batch.column("earlier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, gathered, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            (key, block, probe, digest, component, n), counts, (earlier, taken) = held(batch)
            new = (np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(probe) != 0)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if (key[s], block[s]) != group:
                    group, gathered, tree = (key[s], block[s]), [], None
                rows = (digest[s:e], component[s:e], n[s:e].astype(np.int64), counts[s:e], earlier[s:e], taken[s:e])
                if not probe[s]:
                    gathered.append(rows)  # a block of points, at most a few batches
                    continue
                if not gathered:
                    continue
                if tree is None:
                    ids, comps, sizes, vectors, *before = (np.concatenate(x) for x in zip(*gathered, strict=True))
                    tree = CountTree(vectors, sizes, leaf)
                for p in range(0, e - s, 1024):
                    q, row = tree.search(rows[3][p : p + 1024], rows[2][p : p + 1024], percent)
                    q = q + p
                    apart = rows[1][q] != comps[row]
                    q, row = q[apart], row[apart]
                    first = ~met_before(rows[4:], before, q, row)
                    yield _pair_rows(rows[0][q][first], ids[row][first])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            kept = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                kept.append(bool((100 + percent) * shared >= percent * (len(x) + len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            total = batch.column("n").to_numpy(zero_copy_only=False)
            apart = [least_apart(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            shared = (total - np.array(apart, np.int64)) // 2
            yield batch.select(["a", "b"]).filter(pa.array(may_link(shared, total, percent)))

    return run


def _with(pairs: DataFrame, held: DataFrame, value: str) -> DataFrame:
    left = held.select(F.col("digest").alias("a"), F.col(value).alias("x"), F.col("n").alias("p"))
    right = held.select(F.col("digest").alias("b"), F.col(value).alias("y"), F.col("n").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("p") + F.col("q")).cast("long").alias("n"))


def links_of(docs: DataFrame, size: int, percent: int, group_bits: int, leaf: int, block: int) -> DataFrame:
    """(a, b): links between classes, enough of them to connect every component."""
    keys = prefix_keys(docs, size, percent, ORDER_BITS)
    met = stored(keys.distinct())
    # Most keys are of one set: only least and last are found for all of them.
    ends = met.groupBy("key").agg(F.min("digest").alias("leader"), F.max("digest").alias("last")).where("leader < last")
    several = stored(met.join(ends, "key"))
    sets = several.groupBy("key", "leader", "last").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("digest")).alias("mark"))
    # Near copies share many shingles that nobody else has: of shingles with the same points one is enough.
    one = sets.groupBy("leader", "last", "n", "mark").agg(F.min("key").alias("key"))
    shared = stored(several.join(one.select("key"), "key", "left_semi").select("key", "digest", "leader"))
    held = stored(points(docs, shared.select("digest").distinct(), size, group_bits, FILTER_BITS))

    def linked(pairs: DataFrame) -> DataFrame:
        near = stored(_with(pairs, held, "odd").mapInArrow(_bounded(percent), "a long, b long"))
        ends = stored(near.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
        sets = held.join(ends, "digest", "left_semi")  # the other sets stay where they are
        return stored(_with(near, sets, "shingles").select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long"))

    def still_apart(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links from points to their roots; points of the shingles that lie in several components."""
        found = components(links)
        roots = found.withColumnRenamed("node", "digest")
        placed = stored(shared.join(roots, "digest", "left").select("key", "digest", F.coalesce("root", "digest").alias("component")))
        mixed = (
            placed.groupBy("key")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n_points"), F.min_by("component", "digest").alias("main"))
            .where("low < high")
        )
        stars = found.select(F.col("root").alias("a"), F.col("node").alias("b"))
        return stars, placed.join(mixed.select("key", "n_points", "main"), "key")

    star = shared.where("digest <> leader").select(F.col("leader").alias("a"), F.col("digest").alias("b")).distinct()
    stars, apart = still_apart(linked(star))

    own = Window.partitionBy("digest").orderBy(F.xxhash64("key", "digest"))  # the shingles of one set
    tried = apart.where(F.col("n_points") > PART).withColumn("try", F.row_number().over(own)).where(F.col("try") <= TRIES)
    part = F.pmod(F.xxhash64("digest", "key"), F.ceil(F.col("n_points") / PART))
    parted = stored(tried.select("key", "digest", "component", part.alias("part")))
    heads = parted.groupBy("key", "part").agg(F.min(F.struct("digest", "component")).alias("head"))
    second = (
        parted.join(heads, ["key", "part"])
        .where(F.col("component") != F.col("head.component"))
        .select(F.least("digest", "head.digest").alias("a"), F.greatest("digest", "head.digest").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    second = stored(second)
    stars, apart = still_apart(stars.unionByName(linked(second)))

    blocks = F.ceil(F.col("n_points") / block)
    before = Window.partitionBy("digest").orderBy("key").rowsBetween(-EARLIER, -1)
    rows = stored(apart.select("key", "digest", "component", "main", blocks.alias("blocks"), F.collect_list("key").over(before).alias("earlier")))
    as_points = rows.select("key", "digest", "component", "earlier", F.pmod(F.xxhash64("digest"), "blocks").alias("block"), F.lit(0).alias("probe"))
    probes = rows.where("component <> main").select(
        "key", "digest", "component", "earlier", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("probe")
    )
    pairs = (
        as_points.unionByName(probes)
        .join(held.select("digest", "n", "counts"), "digest")
        .select("key", "block", "probe", "digest", "component", "n", "counts", "earlier")
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "probe")
        .mapInArrow(tree_join(percent, leaf), "a long, b long")
        .distinct()
        .join(star.unionByName(second), ["a", "b"], "left_anti")
    )
    return stars.unionByName(linked(pairs))


def jaccard_groups(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, group_bits: int = GROUP_BITS, leaf: int = LEAF, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, n_shingles, component_id, keeper.

    ``keeper`` marks the document of a component that has its smallest doc_id, rows without one
    last; of rows with one doc_id or none, that of the smaller mark. Rows equal in both are all marked.
    """
    docs = marked(docs)
    all_ = stored(members(docs, size))
    roots = components(links_of(docs, size, percent, group_bits, leaf, block))
    placed = all_.where("n_shingles > 0").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    first = placed.groupBy("root").agg(F.min(place).alias("first"))
    joined = placed.join(first, "root").select(
        "doc_id", "mark", "n_shingles", F.col("first.doc_id").alias("component_id"), place.eqNullSafe(F.col("first")).alias("keeper")
    )
    alone = all_.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper"))
    return joined.unionByName(alone)


def one_of_each_group(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, with all columns, that stand for their group; texts without words all stay."""
    mark = "mark_" + uuid.uuid5(uuid.NAMESPACE_OID, " ".join(docs.columns)).hex[:12]  # clashes with no column
    kept = jaccard_groups(docs, **settings).where("keeper and n_shingles > 0").select("doc_id", "mark").distinct().alias("k")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    held = docs.where(worded).withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    same = F.col("k.doc_id").eqNullSafe(held["doc_id"].cast("long")) & (F.col("k.mark") == held[mark])
    return held.join(kept, same, "left_semi").dropDuplicates(["doc_id", mark]).drop(mark).unionByName(docs.where(~worded))


def op1_ngram_join(spark, folder: str) -> DataFrame:
    return jaccard_groups(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
