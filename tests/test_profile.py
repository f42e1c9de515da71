import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerline.operators.profile import (
    bandwidth,
    box_outliers,
    box_stats,
    describe_columns,
    distribution_shift,
    histogram,
    kernel_density,
    missing_profile,
    round_breaks,
    sturges_bins,
)
from ledgerline.operators.reports import count_report


@pytest.fixture(scope="module")
def fares(spark):
    rng = np.random.default_rng(3)
    values = [float(np.round(x, 2)) for x in rng.exponential(30, 500)] + [8.05] * 250
    rows = [("3" if i % 3 else "1", v) for i, v in enumerate(values)] + [("3", None)]
    return spark.createDataFrame(rows, "pclass string, fare double"), rows


def test_describe_agrees_with_spark(fares):
    frame, _ = fares
    own = {r.column_name: r for r in describe_columns(frame).collect()}
    theirs = {r["summary"]: r for r in frame.describe().collect()}
    assert own["fare"].n == int(theirs["count"]["fare"])
    for name in ("mean", "stddev", "min", "max"):
        assert own["fare"][name] == pytest.approx(float(theirs[name]["fare"]))
        assert own["pclass"].min_text == theirs["min"]["pclass"]
    assert own["pclass"].mean == pytest.approx(float(theirs["mean"]["pclass"]))


def test_missing_profile(spark):
    rows = [(1, None, math.nan), (2, "x", 1.0), (None, None, None), (4, "y", 2.0)]
    frame = spark.createDataFrame(rows, "a int, b string, c double")
    got = {r[0]: tuple(r[1:]) for r in missing_profile(frame).collect()}
    assert got == {"a": (4, 1, 0.25), "b": (4, 2, 0.5), "c": (4, 2, 0.5)}


@pytest.mark.parametrize("per_range", [40, 50_000])
def test_boxes(fares, per_range):
    frame, rows = fares
    got = {r.pclass: r for r in box_stats(frame, "fare", ["pclass"], per_range).collect()}
    outliers = box_outliers(frame, "fare", ["pclass"], per_range).collect()
    for pclass in ("1", "3"):
        values = np.array([v for p, v in rows if p == pclass and v is not None])
        q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        box = got[pclass]
        assert (box.n, box.n_outliers) == (len(values), len(values) - len(inside))
        assert (box.whisker_low, box.whisker_high) == (inside.min(), inside.max())
        assert (box.lower, box.middle, box.upper) == pytest.approx((q1, q2, q3))
        assert sum(r.pclass == pclass for r in outliers) == len(values) - len(inside)


@pytest.mark.parametrize(
    "low, high, intervals, breaks",
    [
        (0.1667, 80.0, 12, (0.0, 5.0, 16)),
        (1.0, 50.0, 17, (0.0, 5.0, 10)),
        (0.0, 1.0, 5, (0.0, 0.2, 5)),
        (-3.2, 3.1, 8, (-4.0, 1.0, 8)),
        (7.0, 7.0, 4, (6.5, 1.0, 1)),
    ],
)
def test_round_breaks(low, high, intervals, breaks):
    assert round_breaks(low, high, intervals) == pytest.approx(breaks)


def test_histogram_is_right_closed_and_sums_to_one(spark):
    values = [0.0, 0.5, 5.0, 5.1, 10.0, 20.0, None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    bins = {r.bin: r for r in histogram(frame, "v", (0.0, 5.0, 4)).collect()}
    assert [bins[i].n for i in range(4)] == [3, 2, 0, 1]
    assert sum(b.density * (b.bin_high - b.bin_low) for b in bins.values()) == pytest.approx(1)


def test_breaks_must_cover_the_values(spark):
    frame = spark.createDataFrame([(1.0,), (21.0,)], "v double")
    with pytest.raises(ValueError, match="cover"):
        histogram(frame, "v", (0.0, 5.0, 4))


def test_histogram_of_nothing(spark):
    assert histogram(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def test_sturges():
    assert [sturges_bins(n) for n in (1, 2, 1046, 1309)] == [1, 2, 12, 12]


def test_shift_of_equal_columns_is_none(fares):
    frame, _ = fares
    for r in distribution_shift(frame.withColumn("again", frame.fare), "fare", "again").collect():
        assert r.n_before == r.n_after and r.density_before == r.density_after


def test_kernel_density(fares):
    frame, rows = fares
    values = np.array([v for _, v in rows if v is not None])
    q1, q3 = np.quantile(values, [0.25, 0.75])
    width = 0.9 * min(values.std(ddof=1), (q3 - q1) / 1.34) * len(values) ** -0.2
    assert bandwidth(frame, "fare") == pytest.approx(width)
    grid = np.linspace(values.min(), values.max(), 64)
    want = np.exp(-((grid[:, None] - values) ** 2) / (2 * width**2)).sum(axis=1)
    want /= len(values) * width * math.sqrt(2 * math.pi)
    got = kernel_density(frame, "fare", points=64).orderBy("point").collect()
    assert [r.x for r in got] == pytest.approx(list(grid))
    assert [r.density for r in got] == pytest.approx(list(want))
    binned = kernel_density(frame, "fare", points=64, nodes=2048).orderBy("point").collect()
    assert [r.density for r in binned] == pytest.approx(list(want), rel=1e-2, abs=1e-6)


def test_kernel_density_far_from_the_values(spark):
    frame = spark.createDataFrame([(0.0,), (0.0,), (1000.0,)], "v double")
    got = kernel_density(frame, "v", points=11, width=0.5).orderBy("point").collect()
    peak = 1 / (0.5 * math.sqrt(2 * math.pi))
    assert [r.density for r in got] == pytest.approx([2 / 3 * peak] + [0] * 9 + [peak / 3])
    beside = kernel_density(frame, "v", points=3, low=-1.0, high=1.0, width=0.5)
    assert [r.density for r in beside.orderBy("point").collect()] == pytest.approx(
        [2 / 3 * peak * math.exp(-2), 2 / 3 * peak, 2 / 3 * peak * math.exp(-2)]
    )
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert kernel_density(same, "v", points=5).count() == 5


def test_count_report_keeps_the_null_key(spark):
    rows = [(None, 1), (None, 1), ("x", 1), ("x", 0), ("y", None)]
    frame = spark.createDataFrame(rows, "state string, survived int")
    report = count_report(frame, ["state"], frame.survived == 1, "survivors", largest_first=True)
    assert [tuple(r) for r in report.collect()] == [(None, 2), ("x", 1)]


@given(
    st.floats(-1e6, 1e6, allow_nan=False), st.floats(1e-3, 1e6), st.integers(1, 40)
)
def test_round_breaks_cover_the_range_in_round_steps(low, spread, intervals):
    first, width, bins = round_breaks(low, low + spread, intervals)
    slack = width * 1e-6
    assert first <= low + slack and low + spread <= first + width * bins + slack
    lead = width / 10 ** math.floor(math.log10(width) + 1e-9)
    assert min(abs(lead - step) for step in (1, 2, 5, 10)) < 1e-6
    assert bins <= 3 * intervals + 3


def test_whole_extremes_keep_their_digits(spark):
    rows = spark.createDataFrame([(9007199254740993,), (1,)], "n long")
    found = describe_columns(rows).first()
    assert (found.min_text, found.max_text) == ("1", "9007199254740993")


def test_infinite_values_have_no_bin(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (math.inf,), (-math.inf,), (None,)], "v double")
    assert sum(r.n for r in histogram(rows, "v").collect()) == 2


def test_density_of_nothing(spark):
    nothing = spark.createDataFrame([], "v double")
    found = kernel_density(nothing, "v", points=5).collect()
    assert [(r.point, r.density) for r in found] == [(k, 0.0) for k in range(5)]
