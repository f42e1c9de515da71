"""Ranks with ranges so small that every path is taken, against plain numpy."""

import bisect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import lookups, ranks
from ledgerline.operators.ranks import distinct_sample, percentiles, range_cuts, running_counts


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value a third of them; nulls, NaN and a null group."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(4000):
        group = None if i % 50 == 0 else ("hot" if i % 4 else f"g{i % 7}")
        value = 5.0 if i % 3 == 0 else float(np.round(rng.lognormal(), 4))
        if i % 41 == 0:
            value = None
        elif i % 97 == 0:
            value = math.nan
        rows.append((group, value))
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6).cache()
    groups = {}
    for group, value in rows:
        if value is not None and not math.isnan(value):
            groups.setdefault(group, []).append(value)
    yield frame, groups
    frame.unpersist()


SHARES = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "high": 1.0}


@pytest.mark.parametrize("per_range", [20, 300, 50_000])
def test_percentiles(skewed, per_range):
    frame, groups = skewed
    got = {r.g: r for r in percentiles(frame, "v", SHARES, ["g"], per_range).collect()}
    assert set(got) == set(groups)
    for group, values in groups.items():
        for name, share in SHARES.items():
            assert got[group][name] == pytest.approx(np.quantile(values, share), abs=1e-12)


@pytest.mark.parametrize("per_range", [20, 50_000])
def test_percentiles_of_whole_table(skewed, per_range):
    frame, groups = skewed
    everything = np.concatenate(list(groups.values()))
    row = percentiles(frame, "v", SHARES, (), per_range).first()
    for name, share in SHARES.items():
        assert row[name] == pytest.approx(np.quantile(everything, share), abs=1e-12)


def test_percentiles_when_the_ranges_wanted_do_not_fit_a_broadcast(skewed, monkeypatch):
    frame, groups = skewed
    monkeypatch.setattr(ranks, "measured", lambda side: lookups.measured(side, max_bytes=0))
    got = percentiles(frame, "v", {"mid": 0.5}, ["g"], 20)
    for row in got.collect():
        assert row.mid == pytest.approx(np.quantile(groups[row.g], 0.5), abs=1e-12)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("per_range", [20, 50_000])
def test_running_counts(skewed, per_range, descending):
    frame, groups = skewed
    counts = {"n": F.lit(1), "twice": F.lit(2)}
    got = {}
    for r in running_counts(frame, "v", counts, ["g"], descending, per_range).collect():
        got[(r.g, r.v)] = (r.n, r.cum_n, r.total_n, r.twice, r.cum_twice, r.total_twice)
    want = {}
    for group, values in groups.items():
        distinct, sizes = np.unique(values, return_counts=True)
        if descending:
            distinct, sizes = distinct[::-1], sizes[::-1]
        for v, n, cum in zip(distinct, sizes, np.cumsum(sizes)):
            want[(group, v)] = (n, cum, len(values), 2 * n, 2 * cum, 2 * len(values))
    assert got == want


def test_group_without_values_has_no_row(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, v double")
    assert [r.g for r in percentiles(frame, "v", {"mid": 0.5}, ["g"]).collect()] == ["a"]


def test_attach_matches_null_keys_both_ways(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, i int")
    side = spark.createDataFrame([("a", 10), (None, 20)], "k string, s int")
    for limit in (0, 1 << 20):
        got = lookups.attach(rows, side, ["k"], max_bytes=limit)
        assert got.columns == ["k", "i", "s"]
        assert {(r.i, r.s) for r in got.collect()} == {(1, 10), (2, 20), (3, None)}


def test_ranges_of_a_mostly_constant_column_are_even(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 100 == 0, F.col("id") * 1.0).otherwise(0.0).alias("v"))
    cuts = range_cuts(rows, "v", 40)
    assert 90 <= len(cuts) <= 101
    values = [100.0 * k for k in range(4000)]
    held = [0] * (len(cuts) + 1)
    for v in values:
        held[bisect.bisect_right(cuts, v)] += 1
    assert max(held) <= 2 * 40
    assert len(range_cuts(rows, "v", 40, max_ranges=8)) == 7
    assert len(range_cuts(rows, "v", 10)) > 300  # more than the first pass has cuts for


def test_a_bounded_sample_cuts_evenly(spark):
    """99 % of the rows have one value; the sample is far smaller than the number of values."""
    rows = spark.range(1_000_000).select(F.when(F.col("id") % 100 == 0, F.sqrt("id")).otherwise(0.0).alias("v")).repartition(9)
    values, n = distinct_sample(rows, "v", 512)
    assert len(values) == 512 and n == pytest.approx(10_000, rel=0.2)
    cuts = range_cuts(rows, "v", 500, sample=512)
    assert 16 <= len(cuts) <= 25
    held = [0] * (len(cuts) + 1)
    for k in range(10_000):
        held[bisect.bisect_right(cuts, math.sqrt(100 * k))] += 1
    assert max(held) <= 2 * 10_000 / len(held)
    found = percentiles(rows, "v", {"p50": 0.5, "p999": 0.999}, (), 500).first()
    assert (found.p50, found.p999) == (0.0, pytest.approx(np.quantile([0.0] * 990_000 + [math.sqrt(100 * k) for k in range(10_000)], 0.999)))


def test_tasks_send_their_sample_only(spark):
    rows = spark.range(100_000, numPartitions=5).select((F.col("id") * 0.5).alias("v"))
    seen = []
    plain = type(rows).mapInArrow

    def counted(frame, *args):
        out = plain(frame, *args)
        seen.append(out.count())
        return out

    type(rows).mapInArrow = counted
    try:
        distinct_sample(rows, "v", 100)
    finally:
        type(rows).mapInArrow = plain
    assert seen == [500]


def test_sample_of_few_or_no_values(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, -0.0, 2.0, math.nan, math.inf, None, 2.0)], "v double")
    assert distinct_sample(rows, "v") == ([0.0, 2.0], 2)
    assert distinct_sample(rows.limit(0), "v") == ([], 0) and range_cuts(rows.limit(0), "v") == []


def test_infinite_values(spark):
    values = [float(k) for k in range(200)] + [math.inf] * 3 + [-math.inf] * 2
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for per_range in (10, 50_000):
        found = percentiles(rows, "v", {"p0": 0.0, "p50": 0.5, "p100": 1.0}, (), per_range).first()
        assert (found.p0, found.p50, found.p100) == (-math.inf, 100.0, math.inf)
