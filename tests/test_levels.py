"""Positions and level indices against plain sorting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.features import FeatureEncoder, encode_levels, slot_names
from ledgerline.operators.levels import LevelIndex
from ledgerline.operators.positions import with_position


def test_positions_over_many_ranges(spark):
    pick = random.Random(1)
    rows = [(pick.randrange(500), pick.choice("abc"), i) for i in range(3000)]
    rows += [(None, "a", 3000), (7, None, 3001)]
    frame = spark.createDataFrame(rows, "x int, t string, i int").repartition(7)
    found = {r.i: r.position for r in with_position(frame, [F.desc("x"), F.asc("t"), F.asc("i")]).collect()}
    expected = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2]))
    assert found == {r[2]: place for place, r in enumerate(expected, 1)}


def test_positions_of_no_rows(spark):
    assert with_position(spark.range(0), [F.asc("id")]).collect() == []


def plain_places(values):
    counts = Counter(v for v in values if v is not None)
    return {v: place for place, v in enumerate(sorted(counts, key=lambda v: (-counts[v], v)))}


@pytest.mark.parametrize("max_bytes", [0, 1 << 25])
def test_ties_nulls_and_a_hot_level(spark, max_bytes):
    pick = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"v{pick.randrange(40)}", pick.randrange(5) * 1.5) for i in range(900)]
    rows += [(900, None, None), (901, "", 0.0), (902, "é", 0.0)]
    frame = spark.createDataFrame(rows, "id int, name string, size double").repartition(5)
    index = LevelIndex.fit(frame, ["name", "size"], max_bytes=max_bytes)
    names, sizes = plain_places([r[1] for r in rows]), plain_places([None if r[2] is None else str(r[2]) for r in rows])
    assert index.sizes == {"name": len(names), "size": len(sizes)}
    assert index.names("name") == sorted(names, key=names.get)
    found = index.transform(frame)
    assert found.columns == ["id", "name", "size", "name_index", "size_index"]
    for r in found.collect():
        assert r.name_index == names.get(r.name) and r.size_index == (None if r["size"] is None else sizes[str(r["size"])])
    other = spark.createDataFrame([(1, "never", None), (2, "hot", 1.5)], "id int, name string, size double")
    got = {r.id: (r.name_index, r.size_index) for r in index.transform(other, unseen=True).collect()}
    assert got == {1: (len(names), len(sizes)), 2: (0.0, sizes["1.5"])}


def test_same_indices_as_the_library(spark):
    from pyspark.ml.feature import StringIndexer

    rows = spark.range(2000).select("id", (F.col("id") * F.col("id") % 37).alias("a"), F.format_string("%s", F.col("id") % 11).alias("b"))
    ours = LevelIndex.fit(rows, ["a", "b"]).transform(rows)
    theirs = StringIndexer(inputCols=["a", "b"], outputCols=["x", "y"]).fit(rows).transform(ours)
    assert theirs.where("a_index <> x or b_index <> y").count() == 0


def test_two_hundred_thousand_levels(spark):
    """Neither counted nor numbered nor joined on the driver; every level keeps its own index."""
    rows = spark.range(300_000).select("id", F.format_string("n%06d", F.col("id") % 200_000).alias("level"))
    index = LevelIndex.fit(rows, ["level"], max_bytes=0)
    assert index.sizes == {"level": 200_000} and not index.small
    found = index.transform(rows)
    # Levels below 100,000 come twice, so by count and name the place is the number itself.
    assert found.where(F.col("level_index") != F.col("id") % 200_000).count() == 0
    assert found.count() == 300_000


def test_encoder_without_names_for_many_levels(spark):
    rows = spark.createDataFrame([(float(i), f"v{i % 5}") for i in range(50)], "x double, c string")
    named = FeatureEncoder.fit(rows, ["x"], ["c"])
    plain = FeatureEncoder.fit(rows, ["x"], ["c"], max_named=3)
    assert slot_names(named.transform(rows)) == ["x", *[f"c_levels_v{i}" for i in range(5)]]
    assert [r.name for r in plain.slots().orderBy("slot").collect()] == slot_names(named.transform(rows))
    vectors = [sorted(tuple(r.features) for r in e.transform(rows).collect()) for e in (named, plain)]
    assert vectors[0] == vectors[1]
    unseen = spark.createDataFrame([(1.0, "other"), (2.0, None)], "x double, c string")
    for encoder in (named, plain):
        assert [tuple(r.features) for r in encoder.transform(unseen).collect()] == [(1.0, 0, 0, 0, 0, 0), (2.0, 0, 0, 0, 0, 0)]


def test_one_hot_from_indices(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    indexed = LevelIndex.fit(rows, ["c"]).transform(rows)
    encoded = encode_levels(["c"]).fit(indexed).transform(indexed)
    assert sorted(tuple(r.c_levels.toArray()) for r in encoded.collect()) == [(0, 1), (1, 0), (1, 0)]
