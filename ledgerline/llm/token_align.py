"""Cross-tokenizer alignment: the tokens of two vocabularies over the same bytes.

Both tokenizers cut ``space + text`` into tokens. Where tokens of both end at one byte, a group ends.
Groups are found along diagonals: while token ``i`` of one side and token ``i + shift`` of the other
end together, stretches of doubling length are compared at once and skipped; where they part, the
group is resolved token by token, which gives the next shift. All pairs of tokens of a group are
linked, and every id pair counts the documents that hold it linked.

Texts are cut and aligned where they lie. What is kept of a text are its groups' digest and its
distinct id pairs, packed. Pairs are counted over all documents; a text finds the counts of the most
frequent pairs, a fixed number, in its task, those of the others by a join in which no pair is hot.

Null and empty texts have no tokens, nor have texts whose tokens' bytes do not give ``space + text``
on both sides; all their numbers are 0 and their digest is empty. Special tokens in texts are plain
text. A text is aligned as a whole, whatever its length; in a group of many tokens on both sides
equal ids are taken together. Every row counts as a document, repeated ones too. An empty table
gives no rows. Extra columns are left alone.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.bpe import byte_letters
from ledgerline.llm.sketch import packed, unpacked
from ledgerline.llm.tables import read, stored, texts
from ledgerline.llm.tallies import counted, head_and_tail

#: Id pairs whose counts are sent to all tasks; 17 bytes each.
FREQUENT = 1 << 20
#: Texts that are cut at once, in characters; a longer one is cut on its own.
CUT_CHARS = 1 << 20
#: Links of a group that are listed one by one.
LISTED = 1 << 12

#: Matching tokens that are compared one by one before stretches are.
SINGLE = 8
# Fixed value: how the byte vocabulary cuts texts before it merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
)


class ByteTokenizer:
    """Byte-level BPE from its JSON file: ids of ``space + text``, special tokens as plain text.

    Where every merge makes the next id, ids are ranks, and a faster library gives the same ids.
    """

    def __init__(self, text: str):
        model = json.loads(text)
        vocabulary = model["model"]["vocab"] | {x["content"]: x["id"] for x in model["added_tokens"]}
        special = {x["content"] for x in model["added_tokens"]}
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.size = max(vocabulary.values()) + 1
        self.bytes = [b""] * self.size
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        merges = (m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"])
        in_order = all(vocabulary.get(m.replace(" ", "")) == i for i, m in enumerate(merges, len(letters)))
        kind = model["pre_tokenizer"] or {}
        usual = not model["normalizer"] and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        if in_order and usual:
            import tiktoken

            ranks = {self.bytes[i]: i for token, i in vocabulary.items() if token not in special}
            encoding = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            self.encode_one = encoding.encode_ordinary
            self.exact = len(letters) == 256 and all(letter in vocabulary for letter in letters)  # no byte is lost
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(text)
            tokenizer.encode_special_tokens = True
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self.encode_one = lambda data: tokenizer.encode(data, add_special_tokens=False).ids
            self.exact = False

    def encode(self, batch: list[str]) -> list[list[int]]:
        return [self.encode_one(" " + text) for text in batch]


class PieceTokenizer:
    """Piece BPE from its model file, which puts the space before a text itself."""

    exact = False

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.processor.get_piece_size()
        self.bytes = [self._bytes(self.processor.id_to_piece(i)) for i in range(self.size)]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, batch: list[str]) -> list[list[int]]:
        return self.processor.encode(batch, num_threads=1)


def group_ends(x: list[int], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side lie before the end of every group.

    ``x`` and ``y`` are the byte offsets where tokens end, rising, and with the same last one.
    """
    i, shift, n = 0, 0, len(x)
    # Tokens of the groups with several tokens on a side: first and last of either side.
    several: list[int] = []
    while i < n:
        if x[i] == y[i + shift]:
            i += 1
            stop = min(n, i + SINGLE)
            while i < stop and x[i] == y[i + shift]:
                i += 1
            if i == stop:
                step = 1
                while step:
                    stretch = x[i : i + step]
                    if stretch and stretch == y[i + shift : i + shift + step]:
                        i += len(stretch)
                        step *= 2
                    else:
                        step //= 2  # one of the stretch parts: what lies before it is found by halving
            if i == n:
                break
            if x[i] == y[i + shift]:
                continue
        j = i + shift
        first = (i, j)
        p, q = x[i], y[j]
        while p != q:
            if p < q:
                i += 1
                p = x[i]
            else:
                j += 1
                q = y[j]
        several += (first[0], i, first[1], j)
        i += 1
        shift = j + 1 - i
    edges = np.array(several, np.int64).reshape(-1, 4).T
    return _last_tokens(n, edges[0], edges[1]), _last_tokens(len(y), edges[2], edges[3])


def _last_tokens(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tokens up to each one that ends a group: all but those from ``first`` on and before ``last``."""
    inside = np.zeros(n + 1, np.int8)
    inside[first] += 1
    inside[last] -= 1
    return np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8) == 0) + 1


def link_pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs, as ``id of x * width + id of y``, and how often each is linked.

    ``a`` and ``b`` count the tokens before the end of every group.
    """
    first_x, first_y = np.append(0, a[:-1]), np.append(0, b[:-1])
    n_x, n_y = a - first_x, b - first_y
    links = n_x * n_y
    small = np.flatnonzero(links <= LISTED)
    ends = np.cumsum(links[small])
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - links[small], links[small])
    group = np.repeat(small, links[small])
    keys = [x[first_x[group] + at // n_y[group]] * width + y[first_y[group] + at % n_y[group]]]
    times = [np.ones(len(keys[0]), np.int64)]
    for g in np.flatnonzero(links > LISTED):
        ids_x, times_x = np.unique(x[first_x[g] : a[g]], return_counts=True)
        ids_y, times_y = np.unique(y[first_y[g] : b[g]], return_counts=True)
        keys.append((ids_x[:, None] * width + ids_y).ravel())
        times.append((times_x[:, None] * times_y).ravel())
    if len(keys) == 1:
        return np.unique(keys[0], return_counts=True)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, place, np.concatenate(times))
    return distinct, sums


class Aligner:
    """Both tokenizers, and what is needed to align and to name their tokens."""

    def __init__(self, json_text: str, model: bytes):
        self.sides = ByteTokenizer(json_text), PieceTokenizer(model)
        self.lengths = [np.array([len(t) for t in side.bytes], np.int64) for side in self.sides]
        # An id and the sign after it: "," within a side, "|" after the first, ";" after the second.
        self.names = [f"{i}{sign}" for side, end in zip(self.sides, "|;", strict=True) for i in range(side.size) for sign in ("," + end)]

    @property
    def width(self) -> int:
        return self.sides[1].size

    def cut(self, batch: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each text; None if they don't give its bytes."""
        out = []
        for text, *ids in zip(batch, *(side.encode(batch) for side in self.sides), strict=True):
            data = b" " + text.encode()
            whole = all(side.exact or b"".join(map(side.bytes.__getitem__, found)) == data for side, found in zip(self.sides, ids, strict=True))
            out.append(tuple(np.array(found, np.int64) for found in ids) if whole else None)
        return out

    def aligned(self, x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Sizes, digest, and linked pairs of a text's tokens."""
        a, b = group_ends(*(np.cumsum(of[found]).tolist() for of, found in zip(self.lengths, (x, y), strict=True)))
        named = np.empty(len(x) + len(y), np.int64)
        # Token i of a side stands after all tokens of the other side's earlier groups.
        for found, ends, before, first in ((x, a, np.append(0, b[:-1]), 0), (y, b, a, self.sides[0].size)):
            code = 2 * (found + first)
            code[ends - 1] += 1
            named[np.arange(len(found)) + np.repeat(before, np.diff(ends, prepend=0))] = code
        digest = hashlib.sha256("".join(map(self.names.__getitem__, named.tolist()))[:-1].encode()).hexdigest()
        keys, times = link_pairs(x, y, a, b, self.width)
        return len(x), len(y), len(a), int(times.sum()), digest, keys, times


@functools.lru_cache(1)
def _aligner(json_text: str, model: bytes) -> Aligner:
    return Aligner(json_text, model)


@dataclass
class Vocabularies:
    """Both vocabulary files for all tasks; their size does not depend on the data."""

    json_text: str
    model: bytes

    @classmethod
    def of(cls, json_path: str, model_path: str) -> Vocabularies:
        with open(json_path, encoding="utf-8") as a, open(model_path, "rb") as b:
            return cls(a.read(), b.read())

    def aligner(self) -> Aligner:
        return _aligner(self.json_text, self.model)


def _chunks(batch: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(batch):
        if i > first and size + len(text) > CUT_CHARS:
            yield first, i
            first, size = i, 0
        size += len(text)
    if batch:
        yield first, len(batch)


def align(docs: DataFrame, shared) -> DataFrame:
    """Sizes, digest of the groups, and packed linked pairs of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, none = shared.value.aligner(), np.zeros(0, np.int64)
        for batch in batches:
            doc_ids, column = batch.column("doc_id"), batch.column("text").fill_null("").to_pylist()
            for s, e in _chunks(column):
                part = column[s:e]
                out = []
                for text, ids in zip(part, aligner.cut(part), strict=True):
                    found = aligner.aligned(*ids) if text and ids else (0, 0, 0, 0, "", none, none)
                    *sizes, digest, keys, times = found
                    out.append((*sizes, digest, packed(np.diff(keys, prepend=0)), packed(times)))
                *sizes, digests, pairs, times = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(s, e - s), *(pa.array(c, pa.int64()) for c in sizes), pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return docs.mapInArrow(run, ALIGNED)


def _pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, distinct pairs and how often each is linked."""
    for i, (pairs, times) in enumerate(zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True)):
        yield i, np.cumsum(unpacked(pairs, np.int64)), unpacked(times, np.int64)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """key, n_docs, and whether n_docs is the most that the pair's first id has with any other."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, keys, _ in _pairs_of(batch):
            yield keys, np.ones((len(keys), 1), np.int64)

    counts = stored(counted(aligned.select("pairs", "times"), found, ["n_docs"]))
    first = F.expr(f"key div {width}")
    best = counts.groupBy(first.alias("first")).agg(F.max("n_docs").alias("most"))
    # One row an id of the first vocabulary, whatever the corpus.
    return counts.join(F.broadcast(best), first == F.col("first")).select("key", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, json_path: str, model_path: str, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    vocabularies = Vocabularies.of(json_path, model_path)
    context = docs.sparkSession.sparkContext
    aligned = stored(align(texts(docs), context.broadcast(vocabularies)).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(aligned, vocabularies.aligner().width))
    head, rare = head_and_tail(counts, "n_docs", frequent)
    shared = context.broadcast(head)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the frequent pairs add to each row."""
        head = shared.value
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)
            for i, keys, times in _pairs_of(batch):
                held, at = head.find(keys)
                at, times = at[held], times[held]
                sums[:, i] = times[head.columns["best"][at]].sum(), (times * head.columns["n_docs"][at]).sum()
            kept = batch.drop_columns(["pairs", "times"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, sums)], [*kept.schema.names, "best_held", "sum_held"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each other pair of a text."""
        head = shared.value
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for i, keys, times in _pairs_of(batch):
                left = ~head.find(keys)[0]
                if left.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(left.sum()), rows[i])), pa.array(keys[left]), pa.array(times[left])], ["row", "key", "n"])

    schema = ALIGNED.replace(", pairs binary, times binary", "")
    found = aligned.mapInArrow(known, f"{schema}, row long, best_held long, sum_held long")
    tail = (
        aligned.select("row", "pairs", "times")
        .mapInArrow(others, "row long, key long, n long")
        .join(rare, "key")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("best_joined"), F.sum(F.col("n") * F.col("n_docs")).alias("sum_joined"))
    )
    added = lambda held, joined: F.col(held) + F.coalesce(F.col(joined), F.lit(0))
    return found.join(tail, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", added("best_held", "best_joined").alias("n_best"),
        added("sum_held", "sum_joined").alias("count_sum"), "groups_sha256",
    )


def op13_token_align(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return alignments(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
