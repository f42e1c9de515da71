"""Indices of text levels by falling frequency, for columns of any number of levels.

Levels are counted, ordered by (column, count, name) and numbered by their place in that order, all
as a table. The table is joined back to rows: broadcast if it measures small, else by a shuffle, in
which a frequent level sits on the large side only. No level passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.lookups import MAX_BROADCAST_BYTES
from ledgerline.operators.positions import with_position
from ledgerline.session import settle


@dataclass
class LevelIndex:
    """``table`` has column_name, level, n, place (from 0 in each column) for the indexed columns."""

    columns: list[str]
    table: DataFrame
    sizes: dict[str, int]
    #: The columns whose levels are few enough to be broadcast.
    small: list[str]

    @classmethod
    def fit(cls, rows: DataFrame, columns: Sequence[str], max_bytes: int = MAX_BROADCAST_BYTES) -> LevelIndex:
        """Levels of all columns in one pass; missing values are no level."""
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns]
        counts = (
            rows.select(F.inline(F.array(*cells)))
            .where("level is not null")
            .groupBy("column_name", "level")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        placed = settle(with_position(counts, [F.asc("column_name"), F.desc("n"), F.asc("level")]))
        # One row a column.
        found = placed.groupBy("column_name").agg(
            F.min("position").alias("first"),
            F.count(F.lit(1)).alias("size"),
            F.sum(F.length("level").cast("bigint") + 32).alias("bytes"),
        ).collect()
        first = F.create_map(*[F.lit(x) for r in found for x in (r.column_name, r["first"])]) if found else None
        place = F.col("position") - first[F.col("column_name")] if found else F.col("position")
        table = placed.select("column_name", "level", "n", place.alias("place"))
        sizes = dict.fromkeys(columns, 0) | {r.column_name: r.size for r in found}
        return cls(list(columns), table, sizes, [r.column_name for r in found if r.bytes <= max_bytes])

    def levels(self, column: str) -> DataFrame:
        return self.table.where(F.col("column_name") == column).select("level", "place")

    def names(self, column: str) -> list[str]:
        """All levels of a column in order, brought to the driver; for few levels."""
        return [r.level for r in self.levels(column).orderBy("place").collect()]

    def transform(self, rows: DataFrame, unseen: bool = False, outputs: Sequence[str] | None = None) -> DataFrame:
        """``rows`` with an index (double) for every column, named ``{column}_index`` or as ``outputs``.

        Missing values and levels that the index does not know have no index, or with ``unseen``
        the number after the last one.
        """
        for column, out in zip(self.columns, outputs or [f"{c}_index" for c in self.columns], strict=True):
            side = self.levels(column).select(F.col("level").alias("__level"), F.col("place").cast("double").alias(out))
            side = F.broadcast(side) if column in self.small else side
            index: Column = F.col(out)
            if unseen:
                index = F.coalesce(index, F.lit(float(self.sizes[column])))
            keyed = rows.withColumn("__level", F.col(column).cast("string"))
            rows = keyed.join(side, "__level", "left").drop("__level").withColumn(out, index)
        return rows
