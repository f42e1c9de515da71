"""Exact running counts and percentiles without gathering a group in one task.

Values are cut into ranges at quantiles of a sample of distinct values. A running count is then a window inside each
(group, range), headed by one row that carries the count of all earlier ranges. Equal values are
added up before any shuffle, so a hot value is one row. The quantiles only balance the ranges;
results do not depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.lookups import measured, null_safe_join

VALUES_PER_RANGE = 50_000
#: Ranges of one column at most; a parameter of ``range_cuts``, to follow the cluster.
MAX_RANGES = 8192
#: Distinct values in the sample that cut points are taken from; eight a range at most ranges.
SAMPLE = 8 * MAX_RANGES

_RANGE = "__range"
_HEAD = "__head"


def _mixed(values: np.ndarray) -> np.ndarray:
    """64 well spread bits of each number."""
    x = values.view(np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def distinct_sample(rows: DataFrame, value: str, size: int = SAMPLE) -> tuple[list[float], float]:
    """A sample of the distinct finite values, in order, and an estimate of how many there are.

    The sample holds the values of the ``size`` smallest hashes, so a value counts once however many
    rows have it. Tasks send their own smallest hashes only, and merging keeps the smallest of
    them. With no more than ``size`` distinct values the sample is all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = np.zeros(0), np.zeros(0, np.uint64)
        for batch in batches:
            found = batch.column("v").drop_null().to_numpy()
            found = found[np.isfinite(found)] + 0.0  # no negative zero
            fresh = _mixed(found)
            if len(hashes) == size:
                near = fresh < hashes[-1]
                found, fresh = found[near], fresh[near]
            hashes, first = np.unique(np.concatenate([hashes, fresh]), return_index=True)
            held = np.concatenate([held, found])[first][:size]
            hashes = hashes[:size]
        order = pa.array((hashes >> np.uint64(1)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([order, pa.array(held)], ["h", "v"])

    column = F.col(value).cast("double").alias("v")
    found = rows.select(column).mapInArrow(run, "h long, v double").distinct().orderBy("h").limit(size).collect()
    n = len(found) if len(found) < size else (size - 1) * 2.0**63 / max(found[-1].h, 1)
    return sorted(r.v for r in found), n


def range_cuts(
    rows: DataFrame,
    value: str,
    values_per_range: int = VALUES_PER_RANGE,
    max_ranges: int = MAX_RANGES,
    sample: int = SAMPLE,
) -> list[float]:
    """Cut points giving about ``values_per_range`` distinct values each; none if few values.

    They come from a sample of distinct values, so one that most rows have takes no more of a range
    than any other. Infinite values lie in the outer ranges and are no cuts.
    """
    values, n = distinct_sample(rows, value, sample)
    ranges = min(max_ranges, math.ceil(n / values_per_range))
    if ranges < 2:
        return []
    return sorted({values[i * len(values) // ranges] for i in range(1, ranges)})


def _with_range(rows: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    splits = [-math.inf, *cuts, math.inf]
    ranged = Bucketizer(splits=splits, inputCol=value, outputCol=_RANGE).transform(rows)
    return ranged.withColumn(_RANGE, F.col(_RANGE).cast("int"))


def _range_heads(
    ranged: DataFrame, by: Sequence[str], counts: Sequence[str], descending: bool
) -> DataFrame:
    """Per (group, range): its own counts, those of the ranges before it, and of the group.

    A group has at most ``MAX_RANGES`` rows here, so these windows are small.
    """
    order = F.col(_RANGE).desc() if descending else F.col(_RANGE).asc()
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = groups.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, _RANGE).agg(*[F.sum(c).alias(c) for c in counts])
    return sizes.select(
        *by,
        _RANGE,
        *counts,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in counts],
        *[F.sum(c).over(groups).alias(f"total_{c}") for c in counts],
    )


def _tallies(
    ranged: DataFrame, value: str, by: Sequence[str], counts: Sequence[str]
) -> DataFrame:
    return ranged.groupBy(*by, _RANGE, value).agg(*[F.sum(c).alias(c) for c in counts])


def _with_next(
    heads: DataFrame, tallies: DataFrame, value: str, by: Sequence[str], counts: Sequence[str], descending: bool
) -> DataFrame:
    """Heads with the counts of the first value of the next range that holds any, as ``after_*``."""
    first = F.max_by if descending else F.min_by
    firsts = tallies.groupBy(*by, _RANGE).agg(*[first(c, value).alias(f"after_{c}") for c in counts])
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    later = groups.orderBy(F.col(_RANGE).desc() if descending else F.col(_RANGE).asc())
    nexts = firsts.select(*by, _RANGE, *[F.lead(f"after_{c}").over(later).alias(f"after_{c}") for c in counts])
    return null_safe_join(heads, nexts, [*by, _RANGE], "left")


def _accumulate(
    tallies: DataFrame,
    heads: DataFrame,
    value: str,
    by: Sequence[str],
    counts: Sequence[str],
    descending: bool,
    following: bool = False,
) -> DataFrame:
    after = [f"after_{c}" for c in counts] if following else []
    head_rows = heads.select(
        *by,
        _RANGE,
        F.lit(True).alias(_HEAD),
        *[F.col(f"before_{c}").alias(c) for c in counts],
        *[f"total_{c}" for c in counts],
        *after,
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    places = Window.partitionBy(*by, _RANGE).orderBy(F.col(_HEAD).desc_nulls_last(), order)
    running = places.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A value's follower stands beside it, or is the first of the next range, which the head carries.
    follower = lambda c: F.coalesce(F.lead(c).over(places), F.max(f"after_{c}").over(running)).alias(f"next_{c}")
    return (
        tallies.unionByName(head_rows, allowMissingColumns=True)
        .select(
            *by,
            _HEAD,
            value,
            *counts,
            *[F.sum(c).over(running).alias(f"cum_{c}") for c in counts],
            *[F.max(f"total_{c}").over(running).alias(f"total_{c}") for c in counts],
            *([follower(c) for c in counts] if following else []),
        )
        .where(F.col(_HEAD).isNull())
        .drop(_HEAD)
    )


def _accumulate_whole(
    rows: DataFrame,
    value: str,
    by: Sequence[str],
    counts: Sequence[str],
    descending: bool,
    distinct: bool,
    following: bool,
) -> DataFrame:
    """With few distinct values a group is small once equal values are added up."""
    tallies = rows
    if not distinct:
        tallies = rows.groupBy(*by, value).agg(*[F.sum(c).alias(c) for c in counts])
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    places = groups.orderBy(F.col(value).desc() if descending else F.col(value).asc())
    running = places.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tallies.select(
        *by,
        value,
        *counts,
        *[F.sum(c).over(running).alias(f"cum_{c}") for c in counts],
        *[F.sum(c).over(groups).alias(f"total_{c}") for c in counts],
        *([F.lead(c).over(places).alias(f"next_{c}") for c in counts] if following else []),
    )


def running_counts(
    rows: DataFrame,
    value: str,
    counts: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    values_per_range: int = VALUES_PER_RANGE,
    cuts: Sequence[float] | None = None,
    distinct: bool = False,
    following: bool = False,
) -> DataFrame:
    """One row per distinct value and group, with own, running and total counts.

    ``counts`` maps a name to a whole-number expression that is added up. Columns out: ``by``,
    the value, and for each name ``name``, ``cum_name`` (through this value) and ``total_name``.
    Missing values are left out. With ``following`` there is also ``next_name``, the own count of
    the next value of the group, null at its last one. ``cuts`` may be known from before, and ``distinct`` says that
    no value comes twice in a group.
    """
    present = rows.select(
        *by,
        F.col(value).cast("double").alias(value),
        *[c.cast("bigint").alias(name) for name, c in counts.items()],
    ).where(F.col(value).isNotNull() & ~F.isnan(value))
    if cuts is None:
        cuts = range_cuts(present, value, values_per_range)
    names = list(counts)
    if not cuts:
        return _accumulate_whole(present, value, by, names, descending, distinct, following)
    ranged = _with_range(present, value, cuts)
    heads = _range_heads(ranged, by, names, descending)
    tallies = ranged if distinct else _tallies(ranged, value, by, names)
    if following:
        heads = _with_next(heads, tallies, value, by, names, descending)
    return _accumulate(tallies, heads, value, by, names, descending, following)


def percentiles(
    rows: DataFrame,
    value: str,
    shares: Mapping[str, float],
    by: Sequence[str] = (),
    values_per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """Exact percentiles per group, interpolated between neighbours; missing values left out.

    With few distinct values the built-in aggregate works on value counts. Otherwise the counts
    per range show which ranges hold the ranks asked for, and only those ranges are ordered.
    """
    present = rows.select(*by, F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    cuts = range_cuts(present, "v", values_per_range)
    if not cuts:
        tallies = present.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
        return tallies.groupBy(*by).agg(
            *[F.percentile("v", F.lit(p), F.col("n")).alias(name) for name, p in shares.items()]
        )

    ranged = _with_range(present, "v", cuts).withColumn("n", F.lit(1).cast("bigint"))

    def position(p: float) -> Column:
        return (F.col("total_n") - 1) * F.lit(float(p))

    def holds(rank: Column, first: Column, size: Column) -> Column:
        return (first <= rank) & (rank < first + size)

    wanted = F.lit(False)
    for p in shares.values():
        for rank in (F.floor(position(p)), F.ceil(position(p))):
            wanted = wanted | holds(rank, F.col("before_n"), F.col("n"))
    heads, fits = measured(_range_heads(ranged, by, ["n"], descending=False).where(wanted))
    if fits:
        needed = heads.select(*by, _RANGE)
        ranged = null_safe_join(ranged, F.broadcast(needed), [*by, _RANGE], "left_semi")
    tallies = _tallies(ranged, "v", by, ["n"])
    counted = _accumulate(tallies, heads, "v", by, ["n"], descending=False).where(
        F.col("total_n").isNotNull()
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(rank, F.col("cum_n") - F.col("n"), F.col("n")), F.col("v")))

    neighbours = counted.groupBy(*by).agg(
        F.max("total_n").alias("total_n"),
        *[at(F.floor(position(p))).alias(f"low_{name}") for name, p in shares.items()],
        *[at(F.ceil(position(p))).alias(f"high_{name}") for name, p in shares.items()],
    )
    return neighbours.select(
        *by,
        *[
            F.when(F.col(f"low_{name}") == F.col(f"high_{name}"), F.col(f"low_{name}"))
            .otherwise(
                F.col(f"low_{name}")
                + (F.col(f"high_{name}") - F.col(f"low_{name}"))
                * (position(p) - F.floor(position(p)))
            )
            .alias(name)
            for name, p in shares.items()
        ],
    )
