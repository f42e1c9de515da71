import pytest
from pyspark.sql import functions as F

from ledgerline.functions import (
    array_item,
    bucket_other,
    last_segment,
    segment_count,
    select_except,
    split_bucket,
    token_after_comma,
    typed_projection,
)


def one_column(frame, column):
    return [r[0] for r in frame.select(column).collect()]


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string").coalesce(1)


@pytest.mark.parametrize(
    "text, state",
    [
        ("St Louis, MO", " MO"),
        ("Belfast, NI / Brooklyn, NY", " NY"),
        ("London / Toronto, ON", " ON"),
        ("London", "London"),
        ("Bristol / London", " London"),
        ("Paris /", ""),
        ("Paris,", ""),
        ("", ""),
        (None, None),
    ],
)
def test_last_segment(spark, text, state):
    assert one_column(texts(spark, [text]), last_segment("t")) == [state]


@pytest.mark.parametrize(
    "name, title",
    [
        ("Doe, Mr. John", "Mr."),
        ("Doe, the Countess. of", "the"),
        ("Doe Mr. John", None),
        ("Doe,Mr. John", "John"),
        ("Doe,", None),
        (None, None),
    ],
)
def test_token_after_comma(spark, name, title):
    assert one_column(texts(spark, [name]), token_after_comma("t")) == [title]


def test_bucket_other(spark):
    frame = texts(spark, ["Mr.", "Mrs.", "the", "mr.", None])
    kept = bucket_other("t", ["Mr.", "Mrs."])
    assert one_column(frame, kept) == ["Mr.", "Mrs.", "Other", "Other", "Other"]


def test_delimiters_are_not_patterns(spark):
    frame = texts(spark, ["a.b.c", None])
    assert one_column(frame, segment_count("t", ".")) == [3, None]
    assert one_column(frame, array_item("t", ".", 2)) == ["c", None]
    assert one_column(frame, array_item("t", ".", 1)) == ["b", None]
    assert one_column(frame, array_item("t", ".", 9)) == [None, None]
    assert one_column(frame, array_item("t", ".b.", 1)) == ["c", None]


def test_typed_projection(spark):
    rows = [("1", "0.8333", "x"), ("28.5", "NA", "y"), ("NA", None, None), ("-3", "1e2", "NA")]
    frame = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1)
    typed = typed_projection(frame, {"a": "int", "b": "float", "c": "string"})
    assert [f.dataType.simpleString() for f in typed.schema] == ["int", "float", "string"]
    got = [tuple(r) for r in typed.collect()]
    assert [g[0] for g in got] == [1, 28, None, -3]
    assert got[0][1] == pytest.approx(0.8333, abs=1e-6)
    assert [g[1] for g in got[1:]] == [None, None, 100.0]
    assert [g[2] for g in got] == ["x", "y", None, "NA"]


def test_select_except(spark):
    frame = spark.range(1).select("id", F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert select_except(frame, ["a"]).columns == ["id", "b"]


def test_split_bucket_ignores_partitioning(spark):
    frame = spark.range(1000)
    first = {r[0]: r[1] for r in frame.select("id", split_bucket("id", 1)).collect()}
    again = {r[0]: r[1] for r in frame.repartition(7).select("id", split_bucket("id", 1)).collect()}
    other = {r[0]: r[1] for r in frame.select("id", split_bucket("id", 2)).collect()}
    assert first == again != other
    assert set(first.values()) == set(range(10))
