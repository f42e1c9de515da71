"""Filtered and grouped count reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.positions import with_position

def count_report(
    rows: DataFrame,
    keys: Sequence[str],
    where: Column | None = None,
    count_name: str = "n",
    largest_first: bool = False,
) -> DataFrame:
    """Rows per key combination; sorted by key, or by count with the keys as tie-break.

    A null key is a group of its own. Counting is done per task before the shuffle, so a key
    holding most rows costs no more than the others.
    """
    kept = rows if where is None else rows.where(where)
    counted = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    return counted.orderBy(*report_order(keys, count_name, largest_first))


def numbered(report: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """A report with each row's place in an order, so that the order outlives writing and joining."""
    return with_position(report, order, name)


def report_order(keys: Sequence[str], count_name: str = "n", largest_first: bool = False) -> list[Column]:
    """The order of ``count_report``: null keys first."""
    return [*([F.desc(count_name)] if largest_first else []), *[F.asc(k) for k in keys]]


def sql_report(spark: SparkSession, text: str) -> DataFrame:
    """The same kind of report as SQL over registered tables."""
    return spark.sql(text)


def value_counts(rows: DataFrame, key: str, count_name: str = "n") -> DataFrame:
    """Frequency table of one column, unordered."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))


def band(column: Column | str, width: float) -> Column:
    """Lower edge of the band of this width that holds the value."""
    return F.floor(F.col(column) / width if isinstance(column, str) else column / width) * width
