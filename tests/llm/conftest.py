import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Columns that operators might use themselves.
CLASHES = ["mark", "digest", "first", "row", "spans", "n", "anchor", "words", "kept", "key", "root", "lines", "mentions", "found"]


@pytest.fixture(scope="session")
def prose():
    """A function that makes ``n`` words of made-up prose from a seed."""

    def make(seed, n, vocabulary=2000):
        pick = random.Random(seed)
        return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def table(spark):
    """A function that makes a documents table of (doc_id, text), with clashing extra columns."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            df = df.selectExpr("*", *(f"concat('x', doc_id) as {name}" for name in CLASHES))
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, blanks, short, long, equal, repeated and unnamed texts."""
    long = prose(1, 30_000)
    x = prose(2, 120)
    near = x.split()
    near[60] = "changed"
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, long),
        (5, "One two three"),
        (6, "one TWO three"),
        (7, x),
        (8, x),
        (9, " ".join(near)),
        (10, long + " tail of it"),
        (11, prose(3, 40) + "\n" + prose(3, 40) + "\n" + prose(3, 40)),
        (12, "é ü 日本 😀 " * 30),
        (14, prose(5, 60)),
        (14, prose(5, 60)),
        (None, prose(6, 50)),
        (None, None),
    ]
