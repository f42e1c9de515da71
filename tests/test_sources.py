import csv
import random

import pytest

from ledgerline.session import shared_path
from ledgerline.sources import (
    preview,
    read_csv_inferred,
    read_csv_text,
    register,
    write_csv,
    write_report,
)


def test_report_keeps_blanks_and_empty_keys(spark):
    path = shared_path(spark, "report")
    rows = [(" NY", 99), ("London", 5), ("  Stamford CT", 2), (None, 3), (" London", 1)]
    write_report(spark.createDataFrame(rows, "state string, n long"), path)
    back = read_csv_text(spark, path)
    assert back.columns == ["state", "n"]
    assert {(r.state, r.n) for r in back.collect()} == {(s, str(n)) for s, n in rows}


def test_missing_token(spark):
    path = shared_path(spark, "gaps")
    write_csv(spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double"), path, missing="NA")
    assert {tuple(r) for r in read_csv_text(spark, path).collect()} == {("1", "NA"), ("2", "0.5")}
    as_null = read_csv_text(spark, path, columns=["a", "b"], missing="NA")
    assert {tuple(r) for r in as_null.collect()} == {("1", None), ("2", "0.5")}
    inferred = read_csv_inferred(spark, path)
    assert [f.dataType.simpleString() for f in inferred.schema] == ["int", "double"]
    assert {tuple(r) for r in inferred.collect()} == {(1, None), (2, 0.5)}


def test_register_and_preview(spark):
    register(spark.range(100).repartition(5), "hundred")
    first = preview(spark.table("hundred"), "id", 3)
    assert [r.id for r in first.collect()] == [0, 1, 2]


def test_csv_keeps_every_value(spark):
    path = shared_path(spark, "odd")
    rows = [("a\nb", 1), (" lead ", 2), ("", 3), (None, 4), ('say ""x"", "y"', 5), ("a,b;c\\", 6), ('"', 7), ("\t", 8)]
    write_csv(spark.createDataFrame(rows, "t string, n long"), path)
    back = read_csv_text(spark, path, columns=["t", "n"], multi_line=True)
    assert sorted((r.t, int(r.n)) for r in back.collect() if r.t is not None) == sorted(r for r in rows if r[0] is not None)
    assert [r.n for r in back.where("t is null").collect()] == ["4"]


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that quoted breaks lie at all borders."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)

    yield use
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("size", [60, 333, 1 << 27])
def test_splits_with_quoted_breaks_equal_whole_files(spark, tmp_path, small_splits, size):
    pick = random.Random(6)
    words = ["a", "line\nbreak", '"', 'say ""', "x,y", "", " blank ", "\n\n", "é日本", "long " * 20 + "\n" + "tail " * 20]
    expected = []
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as file:
            writer = csv.writer(file, lineterminator="\n")
            writer.writerow(["id", "t", "u"])
            for i in range(60):
                row = [f"{name}{i}", "".join(pick.choices(words, k=3)) or "e", pick.choice(words) or "e"]
                writer.writerow(row)
                expected.append(tuple(row))
    whole = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"')
    assert sorted(map(tuple, whole.collect())) == sorted(expected)
    small_splits(size)
    found = read_csv_text(spark, str(tmp_path), multi_line=True)
    if size < 1000:
        assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 20
    assert found.columns == ["id", "t", "u"] and sorted(map(tuple, found.collect())) == sorted(expected)


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    path = tmp_path / "one.csv"
    path.write_text('a,b\r\n1,"' + "\n".join(f"line {i}" for i in range(100)) + '"\r\n\n2,x\r\n')
    small_splits(16)
    found = {r.a: r.b for r in read_csv_text(spark, str(path), multi_line=True).collect()}
    assert found == {"1": "\n".join(f"line {i}" for i in range(100)), "2": "x"}


def test_types_inferred_over_breaks(spark, tmp_path):
    path = tmp_path / "typed.csv"
    path.write_text('i,l,d,day,at,flag,t,none\n1,3000000000,0.5,2024-01-02,2024-01-02 03:04:05,true,"x\ny",NA\n-2,1,NA,2024-02-03,2024-01-02 00:00:00,false,7,NA\n')
    found = read_csv_inferred(spark, str(path), multi_line=True)
    assert [k for _, k in found.dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
    assert sorted((r.i, r.d, r.t) for r in found.collect()) == [(-2, None, "7"), (1, 0.5, "x\ny")]


def test_lines_as_r_writes_them(spark, tmp_path):
    """Quoted names with commas and doubled quotes, NA without quotes, row names first."""
    path = tmp_path / "r.csv"
    path.write_text('"","Name","Age"\n"1","Rheims, Mr. George ""Lucien, X""",NA\n"2","Dean, Miss. Ann",0.5\n')
    text = read_csv_text(spark, str(path), missing="NA").collect()
    assert [(r.Name, r.Age) for r in text] == [('Rheims, Mr. George "Lucien, X"', None), ("Dean, Miss. Ann", "0.5")]
    assert read_csv_inferred(spark, str(path)).select("Age").dtypes == [("Age", "double")]


def test_numbers_are_trimmed_and_cut(spark):
    from ledgerline.functions import typed_projection

    texts = [" 28.5 ", "28.5 ", ".5", "-.5", "7.", "-3.9", "x", ".", "", None, "1e3", " 12"]
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    found = [r.a for r in typed_projection(rows, {"a": "int"}).collect()]
    assert found == [28, 28, 0, 0, 7, -3, None, None, None, None, None, 12]


def test_written_files_are_removed(spark, monkeypatch):
    import os

    from ledgerline import session

    monkeypatch.setattr(session, "_written", [])
    path = shared_path(spark, "gone")
    write_csv(spark.range(3), path)
    assert os.path.isdir(path)
    session.clear_shared(spark)
    assert not os.path.exists(os.path.dirname(path))
