"""Near-duplicate and substring operators against plain versions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm.ngram_join import EARLIER, CountTree, jaccard_groups, least_apart, odd_cells, one_of_each_group, tree_join
from ledgerline.llm.suffix_dedup import longest_previous_factors, remove_later_copies, suffix_array
from ledgerline.llm.window_dedup import remove_repeated_windows


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def groups(df):
    return tuples(df, "doc_id", "n_shingles", "component_id")


def plain_groups(rows):
    sets = [(d, brute.shingles(t)) for d, t in rows]
    of = [c if s else d for (d, s), c in zip(sets, brute.components(sets))]
    return sorted(((d, len(s), c) for (d, s), c in zip(sets, of)), key=repr)


def test_jaccard_groups_of_odd_rows(table, odd_rows):
    assert groups(jaccard_groups(table(odd_rows))) == plain_groups(odd_rows)


def test_jaccard_groups_in_small_blocks(table, prose):
    """Chains and clusters of near copies, with trees of several levels and blocks of few points."""
    pick, rows = random.Random(7), []
    for cluster in range(4):
        text = prose(100 + cluster, 100).split()
        for k in range(30):
            if cluster % 2:
                text[pick.randrange(100)] = f"x{k}"  # a chain: each close to the one before
                copy = text
            else:
                copy = [f"y{k}" if pick.random() < 0.02 else w for w in text]
            rows.append((1000 * cluster + k, " ".join(copy)))
    for k in range(40):  # they share most of their text, but not enough to be linked
        rows.append((9000 + k, prose(500, 60) + " " + prose(600 + k, 25)))
    assert groups(jaccard_groups(table(rows, extra=False), leaf=2, block=8)) == plain_groups(rows)


def test_one_document_of_each_group_stays(spark, table, odd_rows):
    docs = table(odd_rows)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert left == [(False, d) for d in (1, 2, 3, 4, 5, 7, 11, 12, 14)] + [(True, 0)] * 2


def test_one_document_of_a_group_without_ids_stays(table, prose):
    words = prose(7, 100).split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (10, 50, 90)]
    kept = one_of_each_group(table([(None, t) for t in near] + [(None, near[0]), (None, prose(8, 50))])).collect()
    assert len(kept) == 2 and len({r.text for r in kept} & set(near)) == 1
    kept = one_of_each_group(table([(None, near[0]), (3, near[1]), (2, near[2])])).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(2, near[2])]


def test_jaccard_groups_of_nothing(table):
    assert jaccard_groups(table([])).collect() == []


def test_count_tree_rules_out_nothing_that_reaches_the_bound():
    import numpy as np

    pick = np.random.default_rng(3)
    counts = pick.integers(0, 6, (200, 16))
    sizes = counts.sum(axis=1)
    q, p = CountTree(counts, sizes, leaf=4).search(counts, sizes, 80)
    found = set(zip(q.tolist(), p.tolist()))
    shared = np.minimum(counts[:, None], counts[None]).sum(axis=2)
    assert found == set(zip(*(x.tolist() for x in np.nonzero(180 * shared >= 80 * (sizes[:, None] + sizes[None])))))


def letters(seed, n, pool):
    """Texts over few letters, many of them built from shared parts."""
    pick = random.Random(seed)
    parts = ["".join(pick.choice("abé ") for _ in range(pick.randrange(5, 60))) for _ in range(pool)]
    return [(k, "".join(pick.choice(parts) for _ in range(pick.randrange(0, 8)))) for k in range(n)]


@pytest.mark.parametrize("most", [1, 4096])
def test_substring_dedup(table, most):
    rows = letters(5, 60, 25) + [(100, None), (101, ""), (102, "abcab" * 40)]
    made = remove_later_copies(table(rows), size=20, gram=8, sketch_bits=19, max_segments=most)
    assert tuples(made, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.substring_dedup(rows, 20), key=repr)


def test_substring_dedup_of_odd_rows(table, odd_rows):
    made = remove_later_copies(table(odd_rows), sketch_bits=19)
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in made.collect()}
    assert made.count() == len(odd_rows)
    assert removed[1, 0] == removed[2, 0] == removed[None, 0] == 0
    assert removed[7, len(dict(odd_rows)[7])] == 0 and removed[8, len(dict(odd_rows)[8])] == len(dict(odd_rows)[8])
    assert removed[14, len(dict(odd_rows)[14])] == 0  # rows that share id and text are one document
    assert remove_later_copies(table([]), sketch_bits=19).collect() == []


def test_suffix_array_and_factors():
    import numpy as np

    text = "abracadabra_abracadabra"
    data = np.frombuffer(text.encode(), np.uint8) + 2
    order, _ = suffix_array(data, len(text))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    near = np.array([0] + [common(text[i:], text[j:]) for i, j in zip(order, order[1:])])
    found = dict(zip(order.tolist(), longest_previous_factors(order, near).tolist()))
    assert found == {i: max([common(text[i:], text[j:]) for j in range(i)], default=0) for i in range(len(text))}


def test_window_dedup(table, prose):
    pick = random.Random(11)
    parts = [prose(k, pick.randrange(2, 12), 12) for k in range(30)]
    rows = [(k, "  ".join(pick.choice(parts) for _ in range(pick.randrange(0, 12)))) for k in range(80)]
    rows += [(200, None), (201, "a b c d e f g h"), (202, "a b c d e f g h"), (202, "a b c d e f g h"), (None, "x a b c d e f y")]
    made = remove_repeated_windows(table(rows), size=6, gram=3, sketch_bits=19)
    assert tuples(made, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.window_dedup(rows, 6), key=repr)


def test_window_dedup_of_odd_rows(table, odd_rows):
    made = remove_repeated_windows(table(odd_rows), sketch_bits=19)
    assert tuples(made, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.window_dedup(odd_rows, 35), key=repr)
    assert remove_repeated_windows(table([]), sketch_bits=19).collect() == []


def test_counts_of_any_size_are_packed():
    from ledgerline.llm.ngram_join import _packed_counts, _vectors

    for width in (1, 8, 128):
        counts = [np.array([n] * width) for n in (3, 300, 0, 1 << 20)]
        for order in (counts, counts[::-1]):
            found = _vectors(pa.array([_packed_counts(c) for c in order], pa.binary()))
            assert (found == np.array(order)).all()
    assert len(_vectors(pa.array([], pa.binary()))) == 0


def met(keys_of):
    """Pairs that the trees give for points (number -> keys), each its own component, all with equal counts."""
    rows = []
    for point, keys in keys_of.items():
        keys = sorted(keys)
        rows += [(k, 0, probe, point, point, 8, b"\1" * 8, keys[max(0, i - EARLIER) : i]) for i, k in enumerate(keys) for probe in (0, 1)]
    names = ("key", "block", "probe", "digest", "component", "n", "counts", "earlier")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    columns = [pa.array(c, t) for c, t in zip(zip(*sorted(rows), strict=True), kinds, strict=True)]
    found = tree_join(80, 32)(iter([pa.RecordBatch.from_arrays(columns, names)]))
    return [p for b in found for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def test_a_pair_that_meets_under_many_shingles_is_given_once():
    """Apart near copies met under every shingle they share: a hundred rows a pair, in groups that grow with the corpus."""
    pairs = met({point: range(100) for point in range(12)})
    assert set(pairs) == {(a, b) for b in range(12) for a in range(b)}
    assert len(pairs) == 2 * len(set(pairs))  # from both ends


def test_no_pair_that_shares_a_shingle_is_left_out():
    pick = random.Random(4)
    keys_of = {point: pick.sample(range(60), pick.randrange(1, 40)) for point in range(40)}
    expected = {(a, b) for b in keys_of for a in range(b) if set(keys_of[a]) & set(keys_of[b])}
    pairs = met(keys_of)
    assert set(pairs) == expected and len(pairs) < 10 * len(expected)


def test_odd_cells_never_overstate_what_is_apart():
    pick = np.random.default_rng(5)
    for n, m, both in ((0, 3, 0), (1, 1, 1), (40, 90, 30), (500, 510, 450), (500, 3000, 400), (1024, 1025, 0)):
        pool = pick.integers(0, 1 << 64, n + m - both, dtype=np.uint64)
        x, y = pool[:n], pool[n - both :]
        least = least_apart(odd_cells(x), odd_cells(y))
        assert least == least_apart(odd_cells(y), odd_cells(x)) <= n + m - 2 * both
    # Three quarters shared: too little for a link, and told so without the sets.
    pool = pick.integers(0, 1 << 64, 1250, dtype=np.uint64)
    assert 180 * (2000 - least_apart(odd_cells(pool[:1000]), odd_cells(pool[250:]))) / 2 < 80 * 2000


def test_common_shingles_are_told_from_rare_ones_in_a_full_sketch(table):
    """Once a sketch was full, it took all items alike, and passages that many texts share came first."""
    import numpy as np

    from ledgerline.llm.hashing import mix
    from ledgerline.llm.sketch import Commonness

    rare, common = (mix(np.arange(a, z, dtype=np.uint64)) for a, z in ((1, 60_001), (10**6, 10**6 + 20)))

    def hashes(batch):
        ids = batch.column("doc_id").to_numpy()
        yield np.concatenate([rare[i * 300 : i * 300 + 300] for i in ids] + [common] * len(ids))

    docs = table([(i, "") for i in range(200)], extra=False)
    roomy, full = Commonness.of(docs, hashes, 20), Commonness.of(docs, hashes, 14)
    assert (roomy(rare) == 0).mean() > 0.9 and (full(rare) == 0).mean() < 0.1  # 60,000 items in 16,384 cells
    for told in (roomy, full):
        assert told(common).min() >= 2
        assert (told(rare) >= 2).mean() < 0.05


def test_prefixes_leave_out_a_passage_that_many_texts_share(table, prose, monkeypatch):
    """Every text has a near copy and shares a passage with all others; all of them met under it."""
    from ledgerline.llm import ngram_join

    passage = prose(1, 40)
    texts = [passage + " " + prose(10 + k, 80, 10**6) for k in range(70)]
    rows = [*enumerate(texts), *((1000 + k, "one more " + t) for k, t in enumerate(texts))]
    docs = table(rows, extra=False)
    keys = ngram_join.prefix_keys(docs, 5, 80, bits=20).distinct().groupBy("key").count()
    assert keys.where("count > 40").count() == 0 and keys.where("count > 1").count() > 70
    for bits in (20, 9):  # the latter is full
        monkeypatch.setattr(ngram_join, "ORDER_BITS", bits)
        assert groups(jaccard_groups(docs)) == plain_groups(rows)


def test_count_tree_by_size_and_with_large_counts():
    pick = np.random.default_rng(5)
    for top in (3, 400):
        sizes = pick.integers(20, 2000, 300)
        counts = np.stack([np.bincount(pick.integers(0, 16 if top > 3 else 128, n), minlength=128) for n in sizes])
        q, p = CountTree(counts, sizes, leaf=4).search(counts, sizes, 80)
        shared = np.minimum(counts[:, None], counts[None]).sum(axis=2)
        assert set(zip(q.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(180 * shared >= 80 * (sizes[:, None] + sizes[None])))))
