import pytest

from ledgerline.operators.features import FeatureEncoder, slice_features, slot_names, split_by_key
from ledgerline.operators.levels import LevelIndex


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, 22.0, "male", "Mr."),
        (2, 38.0, "female", "Mrs."),
        (3, 26.0, "female", "Miss."),
        (4, 35.0, "male", "Mr."),
    ]
    return spark.createDataFrame(rows, "id int, age double, sex string, title string").coalesce(1)


def test_index_ties_are_alphabetical(people):
    indexed = LevelIndex.fit(people, ["sex", "title"]).transform(people)
    got = {r.id: (r.sex_index, r.title_index) for r in indexed.collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, 2.0), 3: (0.0, 1.0), 4: (1.0, 0.0)}


def test_slots_by_name_and_unseen_levels(spark, people):
    fitted = FeatureEncoder.fit(people, ["age"], ["sex", "title"])
    frame = fitted.transform(people)
    names = slot_names(frame)
    assert names == [
        "age",
        "sex_levels_female",
        "sex_levels_male",
        "title_levels_Mr.",
        "title_levels_Miss.",
        "title_levels_Mrs.",
    ]
    unseen = spark.createDataFrame([(9, 1.0, "male", "Dr.")], people.schema)
    assert list(fitted.transform(unseen).first().features) == [1.0, 0, 1, 0, 0, 0]
    sliced = slice_features(frame, ["title_levels_Mr.", "age"])
    got = {r.id: tuple(r.selected.toArray()) for r in sliced.collect()}
    assert got[1] == (1.0, 22.0) and got[2] == (0.0, 38.0)


def test_split_is_disjoint_and_complete(spark):
    rows = spark.range(5000)
    train, test = split_by_key(rows, "id", seed=7)
    left, right = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert not left & right and len(left | right) == 5000
    assert len(left) == pytest.approx(3500, abs=150)
    again, _ = split_by_key(rows.repartition(3), "id", seed=7)
    assert left == {r.id for r in again.collect()}
