"""Mixed bit predictors against a plain loop over single bits, and the base against counted words."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import context_mixing
from ledgerline.llm.context_mixing import BLOCK, END, ORDERS, REACH, SHARE, SMALL, VARIANTS, Scorer, contexts_of, fitted, gathered, log_odds, op12_context_mixing, portions, scores, split, stretches, tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_base(rows):
    """(n_tokens, n_known, train_tokens, base_score) of every row."""
    tokens = [[*WORD.findall(lower(text)), None] for _, text in rows]
    counts = Counter(t for (i, _), ts in zip(rows, tokens, strict=True) if not is_held(i) for t in ts)
    n, distinct = sum(counts.values()), len(counts)
    for ts in tokens:
        yield len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (distinct + 1))) for t in ts)


def bits_of(text):
    """(contexts with the bits seen so far, bit) for every bit of a text and its end."""
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()) + bytes([END])
    for t, byte in enumerate(data):
        start = t
        while start and t - start < REACH and not (data[start - 1] < 128 and not chr(data[start - 1]).isalnum()):
            start -= 1
        contexts = [(k, data[max(0, t - k) : t]) for k in ORDERS] + [("word", data[start:t])]
        for j in range(8):
            seen = (1 << j) | (byte >> (8 - j))
            yield t, j, [(*c, seen) for c in contexts], byte >> (7 - j) & 1


def plain_counts(texts):
    counts = {}
    for text in texts:
        for _, _, contexts, bit in bits_of(text):
            for c in contexts:
                counts.setdefault(c, [0, 0])[bit] += 1
    return counts


def plain_odds(counts, context):
    return float(log_odds(np.array(counts.get(context, [0, 0])))) * context_mixing.PART


def plain_score(text, counts, weights):
    """log10 of the probability that the mixed variants give a text, bit by bit."""
    blocks = {}
    for t, j, contexts, bit in bits_of(text):
        x = [plain_odds(counts, c) for c in contexts]
        mixed = sum(a * b for a, b in zip(x, weights[4 * j + 2 * (x[-2] != 0) + (x[-1] != 0)], strict=True))
        against = -mixed if bit else mixed
        loss = blocks.setdefault(t // BLOCK, [0.0] * len(VARIANTS))
        for i, v in enumerate(VARIANTS):
            loss[i] += math.log(1 + math.exp(v * against))
    trust, total = [1 / len(VARIANTS)] * len(VARIANTS), 0.0
    for _, loss in sorted(blocks.items()):
        given = [p * math.exp(min(loss) - x) for p, x in zip(trust, loss, strict=True)]
        total += math.log(sum(given)) - min(loss)
        trust = [(1 - SHARE) * g / sum(given) + SHARE / len(VARIANTS) for g in given]
    return total / math.log(10)


def batch(texts, halves=None):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(halves or [0] * len(texts), pa.int32())], ["text", "half"])


TEXTS = ["Some words, some MORE words and more.", "", None, "naïve 日本 text-with_signs\n\ttabs", "some words " * 60, "x" * 700]


def test_tables_count_every_bit(spark, table):
    docs = split(table([(i, t) for i, t in enumerate(TEXTS)])).select("text", "half")
    halves = {r.text: r.half for r in docs.collect()}
    found = tables(docs, 22)
    for which, kept in ((found[0], {0}), (found[1], {1}), (found[2], {0, 1})):
        counts = plain_counts([t for t in TEXTS if halves[t or ""] in kept])
        assert np.count_nonzero(which) == len(counts)  # no two contexts share a cell here
        expected = sorted(round(plain_odds(counts, c) / context_mixing.PART) for c in counts)
        assert sorted(which[which != 0].tolist()) == expected


@pytest.mark.parametrize("piece", [1 << 21, 512])
def test_scores_bit_by_bit(spark, table, monkeypatch, piece):
    """Also in small pieces, which have to go on where the last one stopped."""
    docs = split(table([(i, t) for i, t in enumerate(TEXTS[:5])])).select("text", "half")
    whole = tables(docs, 22)[2]
    counts = plain_counts(TEXTS[:5])
    weights = np.round(np.random.default_rng(1).uniform(0, 0.8, (32, 4)), 3)
    monkeypatch.setattr(context_mixing, "PIECE", piece)
    scorer, loss = Scorer(whole, weights, 22), np.zeros(len(TEXTS))
    for stretch in stretches(batch(TEXTS)):
        rows, lost = scorer.losses(stretch)
        np.add.at(loss, rows, lost)
    for text, lost in zip(TEXTS, loss, strict=True):
        assert -lost / math.log(10) == pytest.approx(plain_score(text, counts, weights), rel=1e-5)


def test_whole_rows(spark, table, odd_rows):
    found = scores(table(odd_rows), bits=18).collect()
    expected = Counter((i, is_held(i), *row[:3], f"{row[3]:.9g}") for (i, _), row in zip(odd_rows, plain_base(odd_rows), strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.9g}") for r in found) == expected
    sizes = Counter((i, len((t or "").encode()) + 1) for i, t in odd_rows)
    assert Counter((r.doc_id, r.n_bytes) for r in found) == sizes
    assert all(r.score < 0 and r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes) for r in found)


@pytest.mark.parametrize("frequent", [0, 3])
def test_rare_words_come_by_a_join(table, odd_rows, frequent):
    order = lambda df: sorted((str(r[:5]), f"{r.base_score:.9g}", r.score) for r in df.collect())
    assert order(scores(table(odd_rows), bits=16, frequent=frequent)) == order(scores(table(odd_rows), bits=16))


def test_probabilities_add_up_to_one():
    """Over all next bytes, whatever came before."""
    pick = np.random.default_rng(2)
    scorer = Scorer(pick.integers(-900, 900, 1 << 16).astype(np.int16), pick.uniform(0, 1, (32, 4)), 16)

    def chance(codes):
        stretch = context_mixing.Stretch(np.array(codes, np.uint8), np.zeros(1, np.int64), 0, np.array([0]), np.array([len(codes)]), 0)
        return math.exp(-scorer.losses(stretch)[1][0])

    before = list(b"some tex")
    # The mix is one over whole texts, so that of a text is the sum over all ways on.
    assert sum(chance([*before, b]) for b in range(256)) == pytest.approx(chance(before), rel=1e-4)
    assert sum(chance([b]) for b in range(256)) == pytest.approx(1, rel=1e-4)


def test_no_training_rows_and_no_rows(table):
    held = next(i for i in range(50) if is_held(i))
    (row,) = scores(table([(held, "one two")]), bits=16).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert row.bits_per_byte == pytest.approx(8)
    assert scores(table([]), bits=16).count() == 0


def test_learned_text_scores_better_than_held_out(spark):
    """On the whole small table: below 8 bits a byte by far, and near the unigram base."""
    found = op12_context_mixing(spark, "/root/testdata/sf0.001").groupBy("held_out").avg("bits_per_byte").collect()
    rates = {r[0]: r[1] for r in found}
    assert rates[False] < rates[True] < 3.5


def test_partitions_do_not_matter(table, odd_rows, prose):
    rows = odd_rows + [(i + 100, prose(i, 80)) for i in range(20)]
    order = lambda df: sorted((str(r.doc_id), r.n_bytes, r.score) for r in df.collect())
    assert order(scores(table(rows).repartition(1), bits=16)) == order(scores(table(rows).repartition(7), bits=16))


def test_contexts_are_gathered_once(spark, table, monkeypatch):
    """Counts and the Newton step each gathered those of all training texts anew."""
    docs = split(table([(i, t) for i, t in enumerate(TEXTS)])).select("text", "half").coalesce(1)
    monkeypatch.setattr(context_mixing, "PORTION", 100)
    rows = docs.toArrow().to_batches()
    (whole,) = gathered(iter(rows), 22)
    found = list(portions(iter(contexts_of(docs, 22).toArrow().to_batches()), 22))
    assert len(found) == -(-len(whole) // 100)
    for name in ("before", "word", "codes"):
        assert np.concatenate([getattr(f, name) for f in found]).tolist() == getattr(whole, name).tolist()
    assert np.concatenate([f.times for f in found], axis=1).tolist() == whole.times.tolist()
    assert whole.times.sum() == sum(len((t or "").encode()) + 1 for t in TEXTS)

    *halves, _ = tables(docs, 16)
    held = spark.createDataFrame(contexts_of(docs, 16).toArrow())
    assert fitted(held, tuple(halves), 16, 1).shape == (32, 4)
