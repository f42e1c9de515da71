"""Alignment of two tokenizers against plain set operations on the public libraries' tokens."""

import bisect
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import token_align
from ledgerline.llm.token_align import Aligner, Vocabularies, alignments, group_ends, link_pairs, op13_token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(tokenizers, text):
    """Ids and bytes of both sides, by the libraries' own ways from tokens to text."""
    first, second = tokenizers
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    in_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
    in_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, in_a, in_b


def ends(parts):
    out, total = [], 0
    for part in parts:
        total += len(part)
        out.append(total)
    return out


def plain(tokenizers, texts):
    """Rows of the query for a list of texts."""
    groups_of = []
    for text in texts:
        groups = []
        if text:
            a, b, in_a, in_b = token_bytes(tokenizers, text)
            whole = (" " + text).encode()
            if b"".join(in_a) == whole and b"".join(in_b) == whole:
                at_a, at_b = ends(in_a), ends(in_b)
                cuts = sorted(set(at_a) & set(at_b))
                groups = [([], []) for _ in cuts]
                for side, (ids, at) in enumerate(((a, at_a), (b, at_b))):
                    for i, e in zip(ids, at, strict=True):
                        groups[bisect.bisect_left(cuts, e)][side].append(i)
        groups_of.append(groups)
    links_of = [Counter((x, y) for xs, ys in groups for x in xs for y in ys) for groups in groups_of]
    docs = Counter(pair for links in links_of for pair in links)
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(n, most.get(x, 0))
    rows = []
    for groups, links in zip(groups_of, links_of, strict=True):
        named = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        rows.append(
            (
                sum(len(xs) for xs, _ in groups),
                sum(len(ys) for _, ys in groups),
                len(groups),
                sum(links.values()),
                sum(n for pair, n in links.items() if docs[pair] == most[pair[0]]),
                sum(n * docs[pair] for pair, n in links.items()),
                hashlib.sha256(named.encode()).hexdigest() if groups else "",
            )
        )
    return rows


ODD = [
    None, "", " ", "\n", "  two  spaces ", "plain words, and more.", "plain words, and more.", "Plain <|endoftext|> and <s> </s> <unk> <0x41>",
    "日本語のテキスト and 😀😀", "naïve café x▁y", "\t\ttabs\r\nand lines\n\n", "x" * 3000, "a\u0000b", "ﬁ ligature ① ½", "é decomposed", " " * 700, "0123456789" * 50,
]


@pytest.mark.parametrize("frequent", [1 << 20, 7, 0])
def test_against_set_operations(spark, table, tokenizers, prose, frequent):
    """With few frequent pairs most counts come by the join."""
    texts = [*ODD, *(prose(i, 30 + i, 60) for i in range(20)), prose(5, 35, 60)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[6]), (None, None)]
    found = alignments(table(rows), A, B, frequent=frequent)
    assert found.columns == ["doc_id", *COLUMNS]
    expected = plain(tokenizers, [t for _, t in rows])
    assert sorted(map(str, found.collect())) == sorted(
        str(r) for r in spark.createDataFrame([(i, *row) for (i, _), row in zip(rows, expected, strict=True)], found.schema).collect()
    )


def test_a_very_long_text_and_no_rows(table, tokenizers, prose):
    long = prose(9, 60_000)
    found = alignments(table([(1, long)]), A, B).first()
    assert tuple(found)[1:] == plain(tokenizers, [long])[0]
    assert alignments(table([]), A, B).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), unique=True, min_size=1), st.lists(st.integers(1, 60), unique=True, min_size=1))
def test_groups_end_where_both_sides_end(x, y):
    last = max(x + y) + 1
    x, y = sorted({*x, last}), sorted({*y, last})
    common = sorted(set(x) & set(y))
    assert [e.tolist() for e in group_ends(x, y)] == [[x.index(c) + 1 for c in common], [y.index(c) + 1 for c in common]]


def test_a_group_of_many_tokens_is_not_listed_link_by_link(monkeypatch):
    import numpy as np

    pick = random.Random(4)
    x, y = (np.array([pick.randrange(9) for _ in range(50)]) for _ in range(2))
    a, b = np.array([3, 40, 50]), np.array([2, 45, 50])
    expected = [c.tolist() for c in link_pairs(x, y, a, b, 100)]
    monkeypatch.setattr(token_align, "LISTED", 10)
    assert [c.tolist() for c in link_pairs(x, y, a, b, 100)] == expected


def test_ids_by_ranks_are_those_of_the_vocabulary(tokenizers, prose):
    """Signs of all kinds, gaps of all kinds, and the vocabulary's own entries side by side."""
    aligner: Aligner = Vocabularies.of(A, B).aligner()
    pick = random.Random(8)
    signs = ["a", "Word", "don't", "naïve", "日本", "😀", "7", "42", ".", ",", "--", "x" * 50, "▁", "é", "<|endoftext|>"]
    gaps = [" ", " ", " ", "  ", "   ", "\n", " \n", "\n ", "\t", "\u00a0", "\u3000 ", " \u2003", "\u001c ", ""]
    texts = ["".join(pick.choice(signs) + pick.choice(gaps) for _ in range(pick.randrange(1, 30))) for _ in range(400)]
    entries = [b.decode(errors="ignore") for b in aligner.sides[0].bytes]
    texts += ["".join(pick.choices(entries, k=4)) for _ in range(5000)] + [prose(1, 300)]
    texts += [f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in range(1, 0x3000)]
    found = aligner.sides[0].encode(texts)
    assert found == [e.ids for e in tokenizers[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_other_merge_orders_go_to_the_public_library():
    import json

    model = json.loads(open(A, encoding="utf-8").read())
    model["model"]["merges"][5:7] = model["model"]["merges"][6:4:-1]
    side = token_align.ByteTokenizer(json.dumps(model))
    assert "tiktoken" not in type(side.encode_one).__module__ and side.encode(["one two"]) == Vocabularies.of(A, B).aligner().sides[0].encode(["one two"])


def test_texts_whose_bytes_are_lost_are_none():
    aligner: Aligner = Vocabularies.of(A, B).aligner()
    assert [ids is None for ids in aligner.cut(["one two", "a▁b"])] == [False, True]


def test_query_on_whole_table(spark, tokenizers):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: row for r, row in zip(docs, plain(tokenizers, [r.text for r in docs]), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in op13_token_align(spark, folder).collect()} == expected
