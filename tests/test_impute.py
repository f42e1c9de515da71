import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators.chained import count_donors, draw_donors, impute_chained_forests
from ledgerline.operators.impute import (
    fill_constant,
    fill_group_median,
    fill_nearest_group,
    replace_column,
)


def test_constant_by_predicate(spark):
    rows = [(1, None, 1), (2, None, 3), (3, "S", 1)]
    frame = spark.createDataFrame(rows, "id int, embarked string, pclass int")
    filled = fill_constant(frame, "embarked", "C", F.col("pclass") == 1)
    assert {(r.id, r.embarked) for r in filled.collect()} == {(1, "C"), (2, None), (3, "S")}
    everywhere = fill_constant(frame, "embarked", "C")
    assert {(r.id, r.embarked) for r in everywhere.collect()} == {(1, "C"), (2, "C"), (3, "S")}


@pytest.mark.parametrize("per_range", [2, 50_000])
def test_group_median(spark, per_range):
    fares = [7.0, 8.05, 8.05, 9.5, None]
    rows = [(i, "3", "S", f) for i, f in enumerate(fares)] + [(5, "3", "S", math.nan)]
    rows += [(10, "3", "Q", None), (11, "1", None, 80.0), (12, "1", None, None)]
    frame = spark.createDataFrame(rows, "id int, pclass string, embarked string, fare double")
    filled = fill_group_median(frame, "fare", ["pclass", "embarked"], per_range)
    assert filled.columns == frame.columns
    got = {r.id: r.fare for r in filled.collect()}
    assert got == {0: 7.0, 1: 8.05, 2: 8.05, 3: 9.5, 4: 8.05, 5: 8.05, 10: None, 11: 80.0, 12: 80.0}


def test_nearest_group_takes_the_port_with_the_nearest_median(spark):
    known = [("C", 1, 76.0), ("C", 1, 84.0), ("S", 1, 50.0), ("S", 1, 54.0), ("Q", 3, 80.0)]
    rows = [(i, e, p, f) for i, (e, p, f) in enumerate(known)]
    rows += [(10, None, 1, 80.0), (11, None, 1, 20.0), (12, None, 2, 80.0)]
    frame = spark.createDataFrame(rows, "id int, embarked string, pclass int, fare double")
    own = fill_nearest_group(frame, "embarked", "pclass", "fare", "fare")
    got = {r.id: r.embarked for r in own.collect()}
    assert (got[10], got[11], got[12], got[0]) == ("C", "S", None, "C")
    fixed = fill_nearest_group(frame, "embarked", "pclass", F.lit(80.0), "fare")
    got = {r.id: r.embarked for r in fixed.collect()}
    assert (got[10], got[11], got[12]) == ("C", "C", None)


def test_replace_column_takes_one_column_only(spark):
    schema = "id int, age double, x string"
    frame = spark.createDataFrame([(1, math.nan, "a"), (2, 5.0, "b")], schema)
    imputed = spark.createDataFrame([(1, 30.0, "z"), (2, 99.0, "z")], schema)
    got = replace_column(frame, imputed, "id", "age").collect()
    assert {tuple(r) for r in got} == {(1, 30.0, "a"), (2, 5.0, "b")}


@pytest.fixture(scope="module")
def leaves(spark):
    """Two trees; one leaf holds most donors and one value most of that leaf."""
    tallies = {
        (0, 0): {1.0: 5, 2.0: 1},
        (0, 1): {7.0: 900, 8.0: 60, 9.0: 40},
        (1, 0): {1.0: 2, 9.0: 4},
        (1, 3): {7.0: 500, 6.0: 500},
    }
    rows = [(t, l, v, n) for (t, l), counts in tallies.items() for v, n in counts.items()]
    donors = spark.createDataFrame(rows, "tree int, leaf int, x double, n long")
    asked = [(i, [0, 0] if i < 1500 else [1, 3], None) for i in range(6000)]
    wanted = spark.createDataFrame(asked, "id int, leaves array<int>, x double")
    return wanted, donors


@pytest.mark.parametrize("per_block, cuts", [(7, [2.0, 7.0]), (1, []), (100_000, None)])
def test_draws_follow_the_pooled_donors(leaves, per_block, cuts):
    wanted, donors = leaves
    drawn = draw_donors(wanted, donors, "x", "id", [1, "x"], 6000, per_block, cuts).collect()
    assert len(drawn) == 6000 and all(r.x is not None for r in drawn)

    def shares(low, high):
        values, counts = np.unique([r.x for r in drawn if low <= r.id < high], return_counts=True)
        return dict(zip(values, counts / counts.sum()))

    few = shares(0, 1500)
    assert set(few) == {1.0, 2.0, 9.0}
    assert few[1.0] == pytest.approx(7 / 12, abs=0.05)
    many = shares(1500, 6000)
    assert set(many) == {6.0, 7.0, 8.0, 9.0}
    assert many[7.0] == pytest.approx(0.7, abs=0.03)


def test_draws_depend_on_key_and_salt_only(leaves):
    wanted, donors = leaves

    def draw(rows, *salts, per_block=50):
        drawn = draw_donors(rows, donors, "x", "id", salts, None, per_block)
        return {r.id: r.x for r in drawn.collect()}

    first = draw(wanted, 1)
    assert first == draw(wanted.repartition(9), 1) == draw(wanted, 1, per_block=3)
    assert first != draw(wanted, 2)


@pytest.fixture(scope="module")
def passengers(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        pclass = int(rng.integers(1, 4))
        age = float(np.round(60 - 12 * pclass + rng.normal(0, 3), 1))
        port = "C" if pclass == 1 else ("S" if rng.random() < 0.8 else "Q")
        siblings = int(rng.integers(0, 3))
        rows.append((i, pclass, age, port, siblings))
    truth = {r[0]: r for r in rows}
    holes = []
    for i, pclass, age, port, siblings in rows:
        if i % 6 == 0:
            age = math.nan if i % 12 == 0 else None
        port = None if i % 9 == 1 else port
        siblings = None if i % 11 == 2 else siblings
        holes.append((i, pclass, age, port, siblings))
    schema = "id int, pclass int, age double, embarked string, sibsp int"
    holed = [(i, p, None if a != a else a, e, s) for i, p, a, e, s in holes]
    return spark.createDataFrame(holes, schema), holed, truth


def test_chained_forests(passengers):
    frame, holed, truth = passengers
    imputed = impute_chained_forests(
        frame, "id", ["age", "embarked", "sibsp"], ["pclass"], iterations=2, trees=5
    )
    assert imputed.schema == frame.schema
    got = {r.id: r for r in imputed.collect()}
    assert len(got) == len(holed)
    places = ((2, "age"), (3, "embarked"), (4, "sibsp"))
    observed = {c: {r[i] for r in holed} - {None} for i, c in places}
    for row in holed:
        for i, c in places:
            value = got[row[0]][c]
            assert value is not None
            assert value == row[i] if row[i] is not None else value in observed[c]
    gaps = [r[0] for r in holed if r[2] is None]
    off = [abs(got[i].age - truth[i][2]) for i in gaps]
    assert np.mean(off) < 6
    first_class = [r[0] for r in holed if r[3] is None and r[1] == 1]
    assert np.mean([got[i].embarked == "C" for i in first_class]) > 0.9


def test_chained_forests_repeat(passengers):
    frame, _, _ = passengers
    first, second = (
        {
            r.id: r.age
            for r in impute_chained_forests(
                frame.select("id", "pclass", "age"), "id", ["age"], ["pclass"], 1, trees=3
            ).collect()
        }
        for _ in range(2)
    )
    assert first == second


def test_too_many_leaves(passengers):
    frame, _, _ = passengers
    with pytest.raises(ValueError, match="leaves"):
        impute_chained_forests(frame, "id", ["age"], ["pclass"], max_depth=20)


def test_chained_copies(passengers):
    frame, holed, _ = passengers
    both = impute_chained_forests(
        frame.select("id", "pclass", "age"), "id", ["age"], ["pclass"], 1, trees=3, copies=2
    ).collect()
    assert sorted({r.imputation for r in both}) == [1, 2] and len(both) == 2 * len(holed)
    ages = {(r.imputation, r.id): r.age for r in both}
    gaps = [r[0] for r in holed if r[2] is None]
    assert any(ages[(1, i)] != ages[(2, i)] for i in gaps)


def test_chained_forests_with_many_levels(spark):
    rows = spark.range(3000).selectExpr(
        "id", "cast(id % 150 as double) as x", "if(id % 11 = 0, null, concat('level ', id % 150)) as c"
    )
    filled = impute_chained_forests(rows, "id", ["c"], ["x"], iterations=1, trees=2)
    assert filled.where("c is null").count() == 0 and filled.count() == 3000
    assert filled.where("id % 11 <> 0 and c <> concat('level ', id % 150)").count() == 0


def test_keys_must_be_unique(spark):
    twice = spark.createDataFrame([(1, 0.5, 1.0), (1, 1.5, None), (2, 2.0, 3.0)], "id long, x double, v double")
    with pytest.raises(ValueError, match="not unique"):
        impute_chained_forests(twice, "id", ["v"], ["x"])
    with pytest.raises(Exception, match="not unique"):
        replace_column(twice, twice.na.fill({"v": 9.0}), "id", "v").collect()


def test_imputation_does_not_depend_on_the_pieces_of_the_input(spark):
    rows = spark.range(800).selectExpr("id", "cast(id % 13 as double) as x", "if(id % 7 = 0, null, cast(id % 29 as double)) as v")

    def run(rows):
        filled = impute_chained_forests(rows, "id", ["v"], ["x"], iterations=2, trees=3)
        return sorted(map(tuple, filled.collect()))

    assert run(rows.coalesce(1)) == run(rows.repartition(11))


@pytest.mark.parametrize("cuts, asked, most", [([], 1, 1 << 20), (None, None, 1 << 20), ([3.0, 3.5, 40.0], 10**6, 3)])
def test_donors_are_packed_by_ranges_of_values(spark, cuts, asked, most):
    """A row a donor and tree took the longest; drawn is what plain lists give."""
    made = [(i, [i % 3, None if i % 5 == 0 else -(i % 7), 9], None if i % 4 == 0 else float(i * 37 % 60)) for i in range(900)]
    rows = spark.createDataFrame([*made, (900, [77, None, 78], None), (901, [0, 0, 9], math.nan)], "id int, leaves array<int>, x double").repartition(4)
    known = F.col("x").isNotNull()
    donors = count_donors(rows.where(known), "x", cuts)
    assert donors.count() < 400
    wanted = rows.where(~known)
    got = {r.id: r.x for r in draw_donors(wanted, donors, "x", "id", ["s", 3], asked, 20, cuts, max_sizes=most).collect()}
    assert len(got) == 226 and got.pop(900) is None
    pools = {}
    for _, leaves, x in made:
        for t, leaf in enumerate(leaves):
            if x is not None and leaf is not None:
                pools.setdefault((t, leaf), []).append(x)
    for i, leaves, x in made:
        if x is None:
            pool = [v for t, leaf in enumerate(leaves) if leaf is not None for v in sorted(pools.get((t, leaf), []))]
            assert got[i] == pool[int(hashlib.md5(f"{i}:s:3".encode()).hexdigest()[:15], 16) % len(pool)]


def test_chained_queries_take_repeated_and_missing_keys(spark, tmp_path, monkeypatch):
    """They ended with an error where a key comes twice, as in copies of a table, or is missing."""
    from compare import open_tables, spark_rows, sql_rows
    from ledgerline.plans import imputation

    made = spark.range(600).selectExpr(
        "id % 250 as o_orderkey",
        "id % 40 as o_custkey",
        "if(id % 3 = 0, 'F', 'O') as o_orderstatus",
        "cast(id * 7 % 101 as double) as o_totalprice",
        "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(id % 900 as int)) as o_orderdate",
        "if(id % 2 = 0, '1-URGENT', '5-LOW') as o_orderpriority",
    )
    made = made.unionByName(made.where("o_orderkey in (17, 26, 30)"))  # rows that come twice
    made.coalesce(1).write.parquet(f"{tmp_path}/parts")
    folder = tmp_path / "repeated"
    folder.mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(folder / "orders.parquet")
    tables = open_tables(str(folder))
    copies = imputation.QUERIES["impute_copies_properties"](spark, str(folder))
    assert spark_rows(copies) == sql_rows(tables, imputation.ORACLE["impute_copies_properties"])
    monkeypatch.setattr(imputation, "CHAINED", imputation.CHAINED | {"iterations": 1, "trees": 2})
    properties = imputation.QUERIES["impute_chained_properties"](spark, str(folder))
    assert spark_rows(properties) == sql_rows(tables, imputation.ORACLE["impute_chained_properties"])

    nameless = made.where("o_orderkey < 60").withColumn("o_orderkey", F.expr("if(o_orderkey < 5, null, o_orderkey)"))
    monkeypatch.setattr(imputation, "read_table", lambda *_: nameless)
    filled = imputation.QUERIES["impute_chained_rf"](spark, "")
    assert filled.columns == ["o_orderkey", "customer", "order_year", "o_orderpriority", "o_totalprice", "o_orderstatus"]
    assert filled.count() == nameless.count() and filled.where("o_totalprice is null or o_orderstatus is null").count() == 0


def test_draws_when_rows_come_in_another_order_each_time(spark, monkeypatch):
    """On several machines each run of a query gives its rows in another order; sizes of leaves were
    gathered column by column, a run each, and no longer fitted together."""
    rows = spark.range(400).selectExpr("id", "array(cast(id % 3 as int), cast(id % 5 as int)) as leaves", "if(id % 4 = 0, null, cast(id * 37 % 60 as double)) as x")
    known = F.col("x").isNotNull()
    donors = count_donors(rows.where(known), "x", [10.0, 30.0, 50.0])

    def drawn():
        return sorted((r.id, r.x) for r in draw_donors(rows.where(~known), donors, "x", "id", ["s"], 100, cuts=[10.0, 30.0, 50.0]).collect())

    plain, gather, pick = drawn(), type(rows).toArrow, np.random.default_rng(3)

    def mixed(frame):
        table = gather(frame)
        return table.take(pick.permutation(table.num_rows))

    monkeypatch.setattr(type(rows), "toArrow", mixed)
    assert drawn() == plain
