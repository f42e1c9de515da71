"""Column profiles: summaries, missing values, boxes, histograms and kernel densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import is_missing
from ledgerline.operators.lookups import attach
from ledgerline.operators.ranks import VALUES_PER_RANGE, percentiles
from ledgerline.session import settle

# Whisker reach in box heights, notch half-width, and the constants of the
# normal-reference bandwidth and of the round-break rule.
WHISKER_REACH = 1.5
NOTCH_WIDTH = 1.58
BANDWIDTH_FACTOR = 0.9
IQR_TO_SD = 1.34
ROUND_STEPS = (2, 5, 10)
ROUND_BIAS = 1.5
BREAK_TOLERANCE = 1e-7
# exp(-x*x/2) is zero in double precision beyond this x.
KERNEL_REACH = 39.0


def _stack(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn one row of ``<field>__<position>`` columns into one row per column."""
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), *[F.col(f"{f}__{i}").alias(f) for f in fields]
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*entries)))


def describe_columns(rows: DataFrame) -> DataFrame:
    """Count, mean, sample deviation and extremes of every column, in one pass.

    Numbers have ``min``/``max``; text has ``min_text``/``max_text``, and a mean if it parses.
    Whole numbers are given as text too, where all their digits are kept.
    """
    columns = [
        f.name
        for f in rows.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.StringType))
    ]
    aggregates = []
    for i, c in enumerate(columns):
        is_text = isinstance(rows.schema[c].dataType, T.StringType)
        number = F.col(c).try_cast("double")
        is_whole = isinstance(rows.schema[c].dataType, (T.IntegralType, T.DecimalType))
        digits = lambda x, whole=is_whole: x.cast("string") if whole else F.lit(None).cast("string")
        bounded = F.lit(None).cast("double") if is_text else number
        aggregates += [
            F.count(c).alias(f"n__{i}"),
            F.mean(number).alias(f"mean__{i}"),
            F.stddev_samp(number).alias(f"stddev__{i}"),
            F.min(bounded).alias(f"min__{i}"),
            F.max(bounded).alias(f"max__{i}"),
            (F.min(c) if is_text else digits(F.min(c))).alias(f"min_text__{i}"),
            (F.max(c) if is_text else digits(F.max(c))).alias(f"max_text__{i}"),
        ]
    fields = ["n", "mean", "stddev", "min", "max", "min_text", "max_text"]
    return _stack(rows.agg(*aggregates), columns, fields)


def missing_profile(rows: DataFrame) -> DataFrame:
    """Missing values per column, in one pass; NaN counts as missing."""
    aggregates = []
    for i, f in enumerate(rows.schema.fields):
        missing = is_missing(rows, f.name)
        aggregates += [
            F.count(F.lit(1)).alias(f"n_rows__{i}"),
            F.count_if(missing).alias(f"n_missing__{i}"),
            F.avg(missing.cast("int")).alias(f"share_missing__{i}"),
        ]
    return _stack(rows.agg(*aggregates), rows.columns, ["n_rows", "n_missing", "share_missing"])


def _with_fences(
    rows: DataFrame, value: str, by: Sequence[str], values_per_range: int
) -> DataFrame:
    quartiles = percentiles(
        rows, value, {"lower": 0.25, "middle": 0.5, "upper": 0.75}, by, values_per_range
    )
    reach = (F.col("upper") - F.col("lower")) * WHISKER_REACH
    present = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    return (
        attach(present, quartiles, by)
        .withColumn("fence_low", F.col("lower") - reach)
        .withColumn("fence_high", F.col("upper") + reach)
    )


def _inside(value: str) -> Column:
    return F.col(value).between(F.col("fence_low"), F.col("fence_high"))


def box_stats(
    rows: DataFrame, value: str, by: Sequence[str], values_per_range: int = VALUES_PER_RANGE
) -> DataFrame:
    """Quartiles, whisker ends, notch and outlier count per group."""
    fenced = _with_fences(rows.select(*by, value), value, by, values_per_range)
    return (
        fenced.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~_inside(value)).alias("n_outliers"),
            F.min(F.when(_inside(value), F.col(value))).alias("whisker_low"),
            F.max("lower").alias("lower"),
            F.max("middle").alias("middle"),
            F.max("upper").alias("upper"),
            F.max(F.when(_inside(value), F.col(value))).alias("whisker_high"),
        )
        .withColumn(
            "notch", F.lit(NOTCH_WIDTH) * (F.col("upper") - F.col("lower")) / F.sqrt("n")
        )
    )


def box_outliers(
    rows: DataFrame, value: str, by: Sequence[str], values_per_range: int = VALUES_PER_RANGE
) -> DataFrame:
    """The rows outside the whiskers of their group."""
    fenced = _with_fences(rows, value, by, values_per_range)
    return fenced.where(~_inside(value)).select(*rows.columns)


def _finite(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < math.inf)


def sturges_bins(n: int) -> int:
    return math.ceil(math.log2(n) + 1)


def round_breaks(low: float, high: float, intervals: int) -> tuple[float, float, int]:
    """First break, width and number of bins: about ``intervals`` bins of a width that is
    1, 2 or 5 times a power of ten, covering ``low`` to ``high``."""
    if low == high:
        return low - 0.5, 1.0, 1
    cell = (high - low) / intervals
    base = 10.0 ** math.floor(math.log10(cell))
    width = base
    for step in ROUND_STEPS:
        bias = 0.5 + 1.5 * ROUND_BIAS if step == 5 else ROUND_BIAS
        if step * base - cell >= bias * (cell - width):
            break
        width = step * base
    first = math.floor(low / width + BREAK_TOLERANCE)
    last = math.ceil(high / width - BREAK_TOLERANCE)
    return first * width, width, last - first


def _shared_breaks(rows: DataFrame, columns: Sequence[str]) -> tuple[float, float, int]:
    """Breaks over the range of all the columns; the bin number follows the fullest one."""
    stats = rows.agg(
        F.array_min(F.array(*[F.min(c) for c in columns])).cast("double").alias("low"),
        F.array_max(F.array(*[F.max(c) for c in columns])).cast("double").alias("high"),
        F.array_max(F.array(*[F.count(c) for c in columns])).alias("n"),
    ).first()
    if not stats.n:
        return 0.0, 1.0, 0
    return round_breaks(stats.low, stats.high, sturges_bins(stats.n))


def _bin(value: Column | str, first: float, width: float) -> Column:
    """Right-closed bin number; the first bin is closed on both sides."""
    value = F.col(value) if isinstance(value, str) else value
    place = F.ceil((value - F.lit(first)) / F.lit(width) - F.lit(BREAK_TOLERANCE))
    return F.greatest(place, F.lit(1)) - 1


def _bin_edges(rows: DataFrame, first: float, width: float, bins: int) -> DataFrame:
    return rows.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(first) + F.col("id") * width).alias("bin_low"),
        (F.lit(first) + (F.col("id") + 1) * width).alias("bin_high"),
    )


def _heights(count: str, density: str, width: float) -> list[Column]:
    """Bin counts, zero where a bin has none, and densities; the window spans the few bins."""
    n = F.coalesce(count, F.lit(0))
    total = F.sum(count).over(Window.partitionBy(F.lit(0)))
    return [n.alias(count), F.try_divide(n, total * width).alias(density)]


def histogram(
    rows: DataFrame, value: str, breaks: tuple[float, float, int] | None = None
) -> DataFrame:
    """Density histogram: one row per bin, empty bins included; heights times widths sum to 1.

    Infinite values have no bin and are left out, as missing ones are.
    """
    present = rows.select(F.col(value).cast("double").alias("v")).where(_finite("v"))
    if breaks is None:
        breaks = _shared_breaks(present, ["v"])
    elif present.where(~F.col("v").between(breaks[0], breaks[0] + breaks[1] * breaks[2])).take(1):
        raise ValueError("the breaks do not cover all values")
    first, width, bins = breaks
    counts = present.groupBy(_bin("v", first, width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most one row per bin, and the number of bins grows with the logarithm of the rows.
    filled = _bin_edges(rows, first, width, bins).join(F.broadcast(counts), "bin", "left")
    return filled.select("bin", "bin_low", "bin_high", *_heights("n", "density", width))


def distribution_shift(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Two density histograms of the same rows on shared breaks, side by side."""
    finite = lambda c: F.when(_finite(F.col(c).cast("double")), F.col(c).cast("double"))
    # Read for the breaks and again for the bins: what made the columns is not computed twice.
    series = settle(rows.select(finite(before).alias("before"), finite(after).alias("after")))
    first, width, bins = _shared_breaks(series, ["before", "after"])
    long = series.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("is_before"), F.col("before").alias("v")),
                F.struct(F.lit(0).alias("is_before"), F.col("after").alias("v")),
            )
        )
    ).where(F.col("v").isNotNull())
    counts = long.groupBy(_bin("v", first, width).alias("bin")).agg(
        F.sum("is_before").alias("n_before"), F.sum(1 - F.col("is_before")).alias("n_after")
    )
    return (
        _bin_edges(rows, first, width, bins)
        .join(F.broadcast(counts), "bin", "left")
        .select(
            "bin",
            "bin_low",
            "bin_high",
            *_heights("n_before", "density_before", width),
            *_heights("n_after", "density_after", width),
        )
    )


def bandwidth(rows: DataFrame, value: str, values_per_range: int = VALUES_PER_RANGE) -> float:
    """Normal-reference bandwidth from deviation, quartile distance and count."""
    spread = rows.agg(F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).first()
    if not spread.n:
        return 1.0
    quartiles = percentiles(rows, value, {"low": 0.25, "high": 0.75}, (), values_per_range).first()
    iqr = (quartiles.high - quartiles.low) / IQR_TO_SD
    narrow = min(x for x in (spread.sd or 0.0, iqr, math.inf) if x > 0)
    narrow = 1.0 if math.isinf(narrow) else narrow
    return BANDWIDTH_FACTOR * narrow * spread.n**-0.2


def kernel_density(
    rows: DataFrame,
    value: str,
    points: int = 512,
    low: float | None = None,
    high: float | None = None,
    width: float | None = None,
    nodes: int | None = None,
    values_per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """Gaussian kernel density on an even grid, by default from the least to the largest value.

    Equal values are counted first. Each distinct value then meets only the grid points where its
    kernel is not zero in double precision, and heights are added up per task. The bandwidth
    shrinks as rows are added, so these become few. With ``nodes`` each value is shared out between
    its two neighbours among that many even nodes first, which bounds the work for continuous data.
    Infinite values are left out; without values the density is zero, on 0 to 1 if no ends are given.
    """
    present = settle(rows.select(F.col(value).cast("double").alias("v")).where(_finite("v")))
    width = bandwidth(present, "v", values_per_range) if width is None else width
    ends = present.agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")
    ).first()
    low = (ends.low if ends.n else 0.0) if low is None else low
    high = (ends.high if ends.n else 1.0) if high is None else high
    weights = present.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if nodes is not None and ends.n and ends.high > ends.low:
        gap = (ends.high - ends.low) / (nodes - 1)
        place = (F.col("v") - ends.low) / gap
        left = F.least(F.floor(place), F.lit(nodes - 2))
        share = place - left
        weights = (
            present.select(
                F.inline(
                    F.array(
                        F.struct(left.alias("node"), (1 - share).alias("w")),
                        F.struct((left + 1).alias("node"), share.alias("w")),
                    )
                )
            )
            .groupBy("node")
            .agg(F.sum("w").alias("n"))
            .select((F.col("node") * gap + ends.low).alias("v"), "n")
        )
    step = (high - low) / (points - 1)
    reach = math.ceil(KERNEL_REACH * width / step) if step > 0 else points
    place = F.floor((F.col("v") - low) / (step or 1.0))
    first = F.greatest(place - reach, F.lit(0))
    last = F.least(place + reach + 1, F.lit(points - 1))
    distance = (F.col("point") * step + low - F.col("v")) / width
    heights = (
        weights.where(first <= last)
        .select("v", "n", F.explode(F.sequence(first, last)).alias("point"))
        .groupBy("point")
        .agg(F.sum(F.col("n") * F.exp(-F.pow(distance, 2) / 2)).alias("height"))
    )
    scale = ends.n * width * math.sqrt(2 * math.pi)
    grid = rows.sparkSession.range(points).withColumnRenamed("id", "point")
    # At most one row per grid point.
    return grid.join(F.broadcast(heights), "point", "left").select(
        F.col("point").cast("int").alias("point"),
        (F.col("point") * step + low).alias("x"),
        (F.coalesce("height", F.lit(0.0)) / (scale or 1.0)).alias("density"),
    )
