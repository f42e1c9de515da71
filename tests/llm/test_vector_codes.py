"""Vector codes against a plain loop over all entries."""

import hashlib
import math
import random

import pytest

from ledgerline.llm.catalog import oracle_sql
from ledgerline.llm.vector_codes import Memo, compress, decompress, op11_vector_codes

from compare import open_tables, spark_rows, sql_rows

SCHEMA = "vec_id long, embedding array<float>, label int, part string, code string"


def plain(rows, parts, entries, rounds):
    """(vec_id, label, code, error) and all codebooks, by brute force."""
    kept = [(i, x, label) for i, x, label in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    kept = sorted(((i is None, i, [math.floor(256 * v) for v in x], label) for i, x, label in kept), key=lambda r: (r[0], r[1] or 0, r[2]))
    size = len(kept[0][2]) // parts
    cut = [[x[p * size : (p + 1) * size] for p in range(parts)] for _, _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(p, c[p])[1], []).append(c[p])
            for e, held in members.items():
                new[p][e] = [sum(column) // len(held) for column in zip(*held, strict=True)]
        books = new
    out = []
    for (_, i, _, label), c in zip(kept, cut, strict=True):
        found = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("edge, cells", [(16, 8192), (1, 3), (1000, 8192)])
def test_against_a_plain_loop(spark, edge, cells):
    pick = random.Random(3)
    rows = [(i, [pick.gauss(0, 0.2) for _ in range(8)], pick.choice([1, 2, None])) for i in range(150)]
    rows += [(200, rows[0][1], 1)] * 5 + [(None, [0.5] * 8, 2), (-1, [-0.003] * 8, None)]
    rows += [(300, None, 1), (301, [0.1, None] * 4, 1), (302, [math.nan] * 8, 1), (303, [math.inf] * 8, 1), (304, [], 1)]
    table = spark.createDataFrame([(i, x, label, "p", "c") for i, x, label in rows], SCHEMA).repartition(3)
    float_rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    coded, books = compress(table, parts=4, entries=10, rounds=2, edge=edge, cells=cells)
    expected, plain_books = plain(float_rows, 4, 10, 2)
    assert order(tuple(r) for r in coded.collect()) == order(expected)
    assert books.books.tolist() == plain_books
    text = ",".join(str(v) for book in plain_books for entry in book for v in entry)
    assert books.sha256() == hashlib.sha256(text.encode()).hexdigest()
    back = {r.vec_id: r.vector for r in decompress(coded, books).collect()}
    error = {r.vec_id: r.error for r in coded.collect()}
    numbers = {i: [math.floor(256 * v) for v in x] for i, x, _ in float_rows if i in back and x and len(x) == 8}
    for i, x in numbers.items():
        assert sum((a - 256 * b) ** 2 for a, b in zip(x, back[i], strict=True)) == error[i]


def test_few_odd_and_no_vectors(spark):
    one = spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.0], 1, "", ""), (8, [1.0, 2.0], 1, "", ""), (9, [1.0, 2.0, 3.0], 1, "", "")], SCHEMA)
    assert [tuple(r) for r in compress(one, parts=4, entries=4)[0].collect()] == [(7, 1, "00000000", 0)]
    huge = spark.createDataFrame([(1, [3e38] * 4, 1, "", ""), (2, [-3e38] * 4, 1, "", "")], SCHEMA)
    assert compress(huge, parts=4, entries=4)[0].agg({"error": "sum"}).first()[0] == 0
    none = spark.createDataFrame([], SCHEMA)
    coded, books = compress(none)
    assert books is None and coded.count() == 0


def test_cells_of_one_hash(monkeypatch):
    """Where all cells have one hash, each is still resolved on its own."""
    import numpy as np

    from ledgerline.llm import vector_codes

    monkeypatch.setattr(vector_codes, "mix", lambda x: np.zeros_like(x))
    pick = np.random.default_rng(5)
    book, x = pick.integers(-100, 100, (20, 3)), pick.integers(-100, 100, (400, 3))
    memo = Memo(book, 8, 1000)
    for part in (x[:100], x[100:], x):
        codes, errors = memo.nearest(part)
        distance = np.square(part[:, None] - book[None]).sum(axis=2)
        assert (codes == distance.argmin(axis=1)).all() and (errors == distance.min(axis=1)).all()


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert spark_rows(op11_vector_codes(spark, folder)) == sql_rows(open_tables(folder), oracle_sql()["op11_vector_codes"])
