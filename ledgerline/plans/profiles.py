"""Summaries, medians, boxes, histograms, densities and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.impute import fill_group_median
from ledgerline.operators.profile import (
    box_outliers,
    box_stats,
    describe_columns,
    distribution_shift,
    histogram,
    kernel_density,
    missing_profile,
)
from ledgerline.operators.ranks import percentiles
from ledgerline.plans.columns import BLANKED_PRICE, blanked_orders
from ledgerline.sources import read_table

PRICE_GROUPS = ["o_orderpriority", "o_orderstatus"]


def _rounded(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def describe_long(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(describe_columns(read_table(spark, folder, "customer")), 4, "mean", "stddev")


def group_median(spark: SparkSession, folder: str) -> DataFrame:
    medians = percentiles(
        blanked_orders(spark, folder), "o_totalprice", {"median": 0.5}, PRICE_GROUPS
    )
    return _rounded(medians, 4, "median")


def mostly_zero_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """A column where 99 rows of 100 have one value: its ranges follow the other values."""
    fee = F.when(F.col("l_orderkey") % 100 == 0, F.col("l_extendedprice")).otherwise(0.0)
    lineitem = read_table(spark, folder, "lineitem").select("l_returnflag", fee.alias("fee"))
    shares = {"p50": 0.5, "p992": 0.992, "p999": 0.999}
    return _rounded(percentiles(lineitem, "fee", shares, ["l_returnflag"], 40), 4, *shares)


def price_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    shares = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    lineitem = read_table(spark, folder, "lineitem")
    found = percentiles(lineitem, "l_extendedprice", shares, ["l_returnflag"])
    return _rounded(found, 4, *shares)


def boxplot_stats(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    boxes = box_stats(lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return _rounded(boxes, 4, "lower", "middle", "upper", "notch")


def boxplot_outliers(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").select("event_id", "event_type", "value")
    return box_outliers(events, "value", ["event_type"])


def histogram_density(spark: SparkSession, folder: str) -> DataFrame:
    bins = histogram(read_table(spark, folder, "lineitem"), "l_quantity")
    return _rounded(bins, 9, "density")


def histogram_price(spark: SparkSession, folder: str) -> DataFrame:
    bins = histogram(read_table(spark, folder, "lineitem"), "l_extendedprice")
    return _rounded(bins, 12, "density")


def _open_returned(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    return lineitem.where((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"))


def kde_grid(spark: SparkSession, folder: str) -> DataFrame:
    curve = kernel_density(_open_returned(spark, folder), "l_quantity")
    return _rounded(curve, 8, "x", "density")


def kde_nodes(spark: SparkSession, folder: str) -> DataFrame:
    curve = kernel_density(
        _open_returned(spark, folder), "l_extendedprice", points=128, nodes=1024
    )
    return curve.withColumns({"x": F.round("x", 4), "density": F.round("density", 12)})


def distribution_before_after(spark: SparkSession, folder: str) -> DataFrame:
    orders = blanked_orders(spark, folder)
    both = orders.withColumn("before", F.col("o_totalprice"))
    filled = fill_group_median(both, "o_totalprice", PRICE_GROUPS)
    shift = distribution_shift(filled, "before", "o_totalprice")
    return _rounded(shift, 12, "density_before", "density_after")


def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(missing_profile(blanked_orders(spark, folder)), 6, "share_missing")


QUERIES = {
    "describe_long": describe_long,
    "group_median": group_median,
    "price_percentiles": price_percentiles,
    "mostly_zero_percentiles": mostly_zero_percentiles,
    "boxplot_stats": boxplot_stats,
    "boxplot_outliers": boxplot_outliers,
    "histogram_density": histogram_density,
    "histogram_price": histogram_price,
    "kde_grid": kde_grid,
    "kde_nodes": kde_nodes,
    "distribution_shift": distribution_before_after,
    "null_profile": null_profile,
}


def _describe_number(column: str, whole: bool) -> str:
    text = "cast({}({}) as varchar)" if whole else "cast(null as varchar)"
    return f"""
        select '{column}' as column_name, count({column}) as n,
               round(avg({column}), 4) as mean, round(stddev_samp({column}), 4) as stddev,
               cast(min({column}) as double) as min, cast(max({column}) as double) as max,
               {text.format("min", column)} as min_text, {text.format("max", column)} as max_text
        from customer"""


def _describe_text(column: str) -> str:
    return f"""
        select '{column}' as column_name, count({column}) as n,
               round(avg(try_cast({column} as double)), 4) as mean,
               round(stddev_samp(try_cast({column} as double)), 4) as stddev,
               cast(null as double) as min, cast(null as double) as max,
               min({column}) as min_text, max({column}) as max_text
        from customer"""


# Bin number, width and first break of a column `v` of a relation `series`.
_BREAKS = """
    spread as (select min(v) as low, max(v) as high, {n} as n from series),
    cells as (select *, (high - low) / ceil(log2(n) + 1) as cell from spread),
    bases as (select *, pow(10, floor(log10(cell))) as base from cells),
    widths as (
        select *, case when 2 * base - cell >= 1.5 * (cell - base) then base
                       when 5 * base - cell >= 2.75 * (cell - 2 * base) then 2 * base
                       when 10 * base - cell >= 1.5 * (cell - 5 * base) then 5 * base
                       else 10 * base end as width
        from bases),
    breaks as (
        select width, floor(low / width + 1e-7) * width as first,
               cast(ceil(high / width - 1e-7) - floor(low / width + 1e-7) as bigint) as bins
        from widths),
    edges as (
        select i as bin, first + i * width as bin_low, first + (i + 1) * width as bin_high,
               width, first
        from breaks, unnest(generate_series(0, bins - 1)) as g(i))"""

_BIN = "cast(greatest(ceil((v - first) / width - 1e-7), 1) - 1 as bigint)"


def _histogram(column: str, digits: int) -> str:
    return f"""
    with series as (select {column} as v from lineitem),
    {_BREAKS.format(n="count(v)")},
    counts as (select {_BIN} as bin, count(*) as n from series, breaks group by 1)
    select bin, bin_low, bin_high, coalesce(n, 0) as n,
           round(coalesce(n, 0) / ((select count(v) from series) * width), {digits}) as density
    from edges left join counts using (bin)"""


_BANDWIDTH = """
    select count(*) as n, min(v) as low, max(v) as high,
           0.9 * least(stddev_samp(v),
                       (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34)
               * pow(count(*), -0.2) as width
    from series"""

_BOXES = """
    select l_returnflag, l_linestatus, quantile_cont(v, 0.25) as lower,
           quantile_cont(v, 0.5) as middle, quantile_cont(v, 0.75) as upper
    from series group by l_returnflag, l_linestatus"""

_INSIDE = "v between lower - 1.5 * (upper - lower) and upper + 1.5 * (upper - lower)"


def _missing(column: str, value: str) -> str:
    return f"""
        select '{column}' as column_name, count(*) as n_rows,
               count(*) - count({value}) as n_missing,
               round(1 - count({value}) / count(*), 6) as share_missing
        from orders"""


_ORDER_COLUMNS = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "o_totalprice",
    "o_orderdate",
    "o_orderpriority",
]

ORACLE = {
    "describe_long": " union all ".join(
        [_describe_number(c, c != "c_acctbal") for c in ("c_custkey", "c_nationkey", "c_acctbal")]
        + [_describe_text(c) for c in ("c_name", "c_mktsegment")]
    ),
    "group_median": f"""
        select o_orderpriority, o_orderstatus, round(quantile_cont(p, 0.5), 4) as median
        from (select *, {BLANKED_PRICE} as p from orders)
        group by o_orderpriority, o_orderstatus""",
    "mostly_zero_percentiles": """
        select l_returnflag, round(quantile_cont(fee, 0.5), 4) as p50,
               round(quantile_cont(fee, 0.992), 4) as p992,
               round(quantile_cont(fee, 0.999), 4) as p999
        from (select l_returnflag,
                     case when l_orderkey % 100 = 0 then l_extendedprice else 0.0 end as fee
              from lineitem)
        group by l_returnflag""",
    "price_percentiles": """
        select l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 4) as p01,
               round(quantile_cont(l_extendedprice, 0.5), 4) as p50,
               round(quantile_cont(l_extendedprice, 0.99), 4) as p99
        from lineitem group by l_returnflag""",
    "boxplot_stats": f"""
        with series as (select *, l_extendedprice as v from lineitem), boxes as ({_BOXES})
        select l_returnflag, l_linestatus, count(*) as n,
               count(*) filter (not {_INSIDE}) as n_outliers,
               min(v) filter ({_INSIDE}) as whisker_low, round(any_value(lower), 4) as lower,
               round(any_value(middle), 4) as middle, round(any_value(upper), 4) as upper,
               max(v) filter ({_INSIDE}) as whisker_high,
               round(1.58 * (any_value(upper) - any_value(lower)) / sqrt(count(*)), 4) as notch
        from series join boxes using (l_returnflag, l_linestatus)
        group by l_returnflag, l_linestatus""",
    "boxplot_outliers": """
        with boxes as (
            select event_type, quantile_cont(value, 0.25) as lower,
                   quantile_cont(value, 0.75) as upper
            from events group by event_type)
        select event_id, event_type, value
        from events join boxes using (event_type)
        where value < lower - 1.5 * (upper - lower) or value > upper + 1.5 * (upper - lower)""",
    "histogram_density": _histogram("l_quantity", 9),
    "histogram_price": _histogram("l_extendedprice", 12),
    "kde_grid": f"""
        with series as (
            select l_quantity as v from lineitem
            where l_linestatus = 'F' and l_returnflag = 'R'),
        spread as ({_BANDWIDTH}),
        tallies as (select v, count(*) as k from series group by v),
        grid as (
            select i as point, i * (high - low) / 511 + low as x, n, width
            from spread, unnest(generate_series(0, 511)) as g(i))
        select cast(point as integer) as point, round(any_value(x), 8) as x,
               round(sum(k * exp(-pow((x - v) / width, 2) / 2))
                     / (any_value(width) * sqrt(2 * pi()) * any_value(n)), 8) as density
        from grid, tallies group by point""",
    "kde_nodes": f"""
        with series as (
            select l_extendedprice as v from lineitem
            where l_linestatus = 'F' and l_returnflag = 'R'),
        spread as ({_BANDWIDTH}),
        places as (
            select (v - low) / ((high - low) / 1023) as place,
                   least(floor((v - low) / ((high - low) / 1023)), 1022) as node
            from series, spread),
        shares as (
            select node, 1 - (place - node) as w from places
            union all select node + 1, place - node from places),
        tallies as (
            select node * ((high - low) / 1023) + low as v, sum(w) as k
            from shares, spread group by 1),
        grid as (
            select i as point, i * ((high - low) / 127) + low as x, n, width
            from spread, unnest(generate_series(0, 127)) as g(i))
        select cast(point as integer) as point, round(any_value(x), 4) as x,
               round(sum(k * exp(-pow((x - v) / width, 2) / 2))
                     / (any_value(width) * sqrt(2 * pi()) * any_value(n)), 12) as density
        from grid, tallies group by point""",
    "distribution_shift": f"""
        with prices as (
            select o_orderpriority, o_orderstatus, {BLANKED_PRICE} as p from orders),
        medians as (
            select o_orderpriority, o_orderstatus, quantile_cont(p, 0.5) as m
            from prices group by o_orderpriority, o_orderstatus),
        series as (
            select true as is_before, p as v from prices where p is not null
            union all
            select false, coalesce(p, m)
            from prices join medians using (o_orderpriority, o_orderstatus)),
        {_BREAKS.format(n="count(*) filter (not is_before)")},
        counts as (
            select {_BIN} as bin, count(*) filter (is_before) as n_before,
                   count(*) filter (not is_before) as n_after
            from series, breaks group by 1)
        select bin, bin_low, bin_high, coalesce(n_before, 0) as n_before,
               coalesce(n_after, 0) as n_after,
               round(coalesce(n_before, 0)
                     / ((select sum(n_before) from counts) * width), 12) as density_before,
               round(coalesce(n_after, 0)
                     / ((select sum(n_after) from counts) * width), 12) as density_after
        from edges left join counts using (bin)""",
    "null_profile": " union all ".join(
        _missing(c, BLANKED_PRICE if c == "o_totalprice" else c) for c in _ORDER_COLUMNS
    ),
}
