"""Filling missing values by constants, group medians and nearest groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import is_missing, known
from ledgerline.operators.lookups import attach
from ledgerline.operators.ranks import VALUES_PER_RANGE, percentiles
from ledgerline.session import settle

#: Medians that a row looks through for its nearest group.
MAX_LEVELS = 10_000


def fill_constant(
    rows: DataFrame, column: str, value: object, where: Column | None = None
) -> DataFrame:
    """Put ``value`` where the column is missing and ``where`` holds."""
    gap = is_missing(rows, column) if where is None else is_missing(rows, column) & where
    return rows.withColumn(column, F.when(gap, F.lit(value)).otherwise(F.col(column)))


def fill_group_median(
    rows: DataFrame, column: str, by: Sequence[str], values_per_range: int = VALUES_PER_RANGE
) -> DataFrame:
    """Put the exact median of the row's group where the column is missing."""
    medians = percentiles(rows, column, {"__median": 0.5}, by, values_per_range)
    filled = attach(rows, medians, by)
    value = F.coalesce(known(rows, column), "__median")
    return filled.withColumn(column, value).select(*rows.columns)


def fill_nearest_group(
    rows: DataFrame,
    column: str,
    within: str,
    value: Column | str,
    measure: str,
    values_per_range: int = VALUES_PER_RANGE,
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """Where the category ``column`` is missing, put the one, among rows of the same ``within``,
    whose median ``measure`` is nearest ``value``; the first by name if two are as near. Each row looks through the medians
    of its ``within``, so their number is bounded by ``max_levels``."""
    value = F.col(value) if isinstance(value, str) else value
    complete = rows.where(~is_missing(rows, column))
    medians = settle(
        percentiles(complete, measure, {"median": 0.5}, [within, column], values_per_range)
    )
    widest = medians.groupBy(within).count().agg(F.max("count")).first()[0] or 0
    if widest > max_levels:
        raise ValueError(f"more than {max_levels} levels in {column}: bucket the rare ones first")
    boxes = medians.groupBy(within).agg(
        F.collect_list(F.struct("median", F.col(column).alias("category"))).alias("__medians")
    )
    nearest = F.array_min(
        F.transform(
            "__medians",
            lambda m: F.struct(
                F.abs(m["median"] - value).alias("gap"), m["category"].alias("category")
            ),
        )
    )["category"]
    filled = attach(rows, boxes, [within])
    return filled.withColumn(column, F.coalesce(known(rows, column), nearest)).select(*rows.columns)


def replace_column(rows: DataFrame, imputed: DataFrame, key: str, column: str) -> DataFrame:
    """Take one column from an imputed copy of the table, by key; the copy's others are left.

    Only rows with a gap are joined. The key must be unique among the copy's rows that they meet.
    """
    gap = is_missing(rows, column)
    open_rows = rows.where(gap)
    taken = imputed.select(key, F.col(column).alias("__imputed"))
    one = taken.join(open_rows.select(key), key, "left_semi").groupBy(key).agg(
        F.first("__imputed", ignorenulls=True).alias("__imputed"), F.count(F.lit(1)).alias("__n")
    )
    unique = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{key} is not unique in the imputed copy")))
    value = F.coalesce(unique.cast(rows.schema[column].dataType), F.col("__imputed")).alias("__value")
    filled = open_rows.join(one.select(key, value), key, "left").withColumn(column, F.col("__value"))
    return rows.where(~gap).unionByName(filled.select(*rows.columns))
