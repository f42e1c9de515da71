"""Byte-pair encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; a heap holds the merge ranks of neighbouring pairs,
and entries whose symbols have changed since are skipped. Decoding puts the vocabulary's strings
together. Words repeat, so every Python worker keeps the latest ones; the cache has a fixed size.

Nulls count as empty texts, which have no tokens. Texts are encoded as a whole, in the order of
their words, whatever their length. Repeated rows give repeated results; extra columns are left alone.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import read, texts

#: Words, and pieces of words, that a worker remembers; their ids are held as packed bytes.
CACHED_WORDS = 1 << 17
WORD_END = "</w>"
#: Rows that are worked through at once.
PART = 1000

ENCODED = "doc_id long, n_tokens long, ids array<int>"
DECODED = f"{ENCODED}, decoded string"

# White space of the vocabulary's patterns, and its pattern for pieces of words.
WHITE = "\t-\r \x85\xa0  -     　"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, text: str):
        model = json.loads(text)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        strings = {i: s for s, i in chain(self.vocab.items(), self.special.items())}
        self.strings = pa.array([strings.get(i, "") for i in range(max(strings) + 1)])
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.words = re.compile(f"[^{WHITE}]+").findall
        self.pieces = regex.compile(PIECE).findall
        self.word = functools.lru_cache(CACHED_WORDS)(self._word)
        self.piece = functools.lru_cache(CACHED_WORDS)(self._piece)

    def _piece(self, piece: str) -> bytes:
        symbols = [self.letters[b] for b in piece.encode()]
        symbols[-1] += WORD_END
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if found := self.merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self.merges.get((ids[i], ids[j]), (0, -1))[1] != made:
                continue  # stale: one of its symbols has been merged meanwhile
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := self.merges.get((made, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := self.merges.get((ids[h], made))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return array("i", [i for i in ids if i >= 0]).tobytes()

    def _word(self, word: str | bytes) -> bytes:
        return b"".join(map(self.piece, self.pieces(word if isinstance(word, str) else word.decode("ascii"))))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        out = []
        for part in self.parts(text) if any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part.isascii():  # bytes split at the ASCII characters of WHITE, and at no others
                out += map(self.word, part.encode("ascii").lower().split())
            else:
                # Letter by letter: the end of a word changes no sigma.
                lower = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += map(self.word, self.words(lower))
        return np.frombuffer(b"".join(out), np.int32)


@functools.lru_cache(2)
def _codec(text: str) -> Codec:
    return Codec(text)


def vocabulary(spark, path: str):
    """The vocabulary file for all tasks; its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, PART):
            yield batch.slice(a, PART)
    pa.default_memory_pool().release_unused()  # the worker stays; what Arrow holds for later would too


def _encoded(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
    ids = [codec.encode(t or "") for t in part.column("text").to_pylist()]
    cuts = np.cumsum([0, *map(len, ids)])
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(cuts), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])


def _decoded(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
    ids = part.column("ids").fill_null([])
    words = pa.LargeListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))), pa.int64()), codec.strings.take(ids.flatten())
    )
    return pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(words.cast(pa.list_(pa.string())), " ")], [*part.schema.names, "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids for every row of ``docs``."""
    vocab = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value)
        for part in _parts(batches):
            yield _encoded(codec, part)

    return texts(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``decoded`` beside doc_id, n_tokens and ids: the vocabulary's strings of all ids, one space between."""
    vocab = vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value)
        for part in _parts(batches):
            yield _decoded(codec, part)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """What ``decode(encode(docs))`` gives, in one pass: a task has one Python worker and one codec, not two."""
    vocab = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value)
        for part in _parts(batches):
            yield _decoded(codec, _encoded(codec, part))

    return texts(docs).mapInArrow(run, DECODED)


def op6_bpe(spark, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = encode_and_decode(read(spark, folder, "documents"), path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
