"""Global positions in an order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import settle

_PART = "__part"
_PLACE_BITS = 33  # of Spark's increasing ids, which number the rows of a partition from 0


def with_position(rows: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place, from 1 on, in this order.

    Rows are cut into ranges of the order and sorted inside them; a row's place is its place in its
    range behind the sizes of the earlier ranges. Only these sizes, a number a range, reach the
    driver. Equal rows of the order lie in one range, so callers count equal rows first.
    """
    ordered = settle(rows.orderBy(*order))
    placed = ordered.select(
        "*",
        F.spark_partition_id().alias(_PART),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias(name),
    )
    sizes = {r[_PART]: r.n for r in placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    before = SparkSession.active().createDataFrame(offsets, f"{_PART} int, __before long")
    return (
        placed.join(F.broadcast(before), _PART)
        .withColumn(name, F.col("__before") + F.col(name) + 1)
        .drop(_PART, "__before")
    )
