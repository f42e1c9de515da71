"""Feature vectors from flat columns, and splits by key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import split_bucket
from ledgerline.operators.levels import LevelIndex

#: Slots that are named on the driver, which holds a number for each in every model anyway.
MAX_NAMED = 10_000
_UNSEEN = "__unseen"


def encode_levels(columns: Sequence[str], keep_last: bool = True) -> OneHotEncoder:
    return OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns],
        outputCols=[f"{c}_levels" for c in columns],
        dropLast=not keep_last,
    )


@dataclass
class FeatureEncoder:
    """One vector from numbers and categories: the numbers, then one slot per level of each category.

    Levels not seen in fitting, and missing ones, have zeros in their block.
    """

    numbers: list[str]
    levels: LevelIndex | None
    stages: PipelineModel
    #: Levels by category, if there are few enough to name the slots.
    named: dict[str, list[str]]

    @classmethod
    def fit(cls, rows: DataFrame, numbers: Sequence[str], categories: Sequence[str], max_named: int = MAX_NAMED) -> FeatureEncoder:
        levels = LevelIndex.fit(rows, categories) if categories else None
        few = bool(levels) and sum(levels.sizes.values()) <= max_named
        named = {c: levels.names(c) for c in categories} if few else {}
        encoder = cls(list(numbers), levels, None, named)
        vector = [*numbers, *[f"{c}_levels" for c in categories]]
        stages = [encode_levels(categories, keep_last=False)] if categories else []
        stages.append(VectorAssembler(inputCols=vector, outputCol="features"))
        encoder.stages = Pipeline(stages=stages).fit(encoder._indexed(rows))
        return encoder

    def _indexed(self, rows: DataFrame) -> DataFrame:
        if not self.levels:
            return rows
        rows = self.levels.transform(rows, unseen=True)
        for c in self.levels.columns:
            # The last value, which the encoder drops, stands for levels not seen.
            size = {"vals": [*self.named[c], _UNSEEN]} if c in self.named else {"num_vals": self.levels.sizes[c] + 1}
            index = f"{c}_index"
            rows = rows.withColumn(index, F.col(index).alias(index, metadata={"ml_attr": {"type": "nominal", "name": index} | size}))
        return rows

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.stages.transform(self._indexed(rows))

    def slots(self) -> DataFrame:
        """Number and name of every slot, as a table."""
        spark = SparkSession.active()
        found = spark.createDataFrame(list(enumerate(self.numbers)), "slot long, name string")
        first = len(self.numbers)
        for c in self.levels.columns if self.levels else []:
            found = found.unionByName(self.levels.levels(c).select((F.col("place") + first).alias("slot"), F.concat(F.lit(f"{c}_levels_"), "level").alias("name")))
            first += self.levels.sizes[c]
        return found


def slot_names(frame: DataFrame, features: str = "features") -> list[str]:
    """Names of the vector's slots, from the metadata the assembler leaves on the column."""
    groups = frame.schema[features].metadata["ml_attr"]["attrs"]
    slots = [(a["idx"], a["name"]) for attrs in groups.values() for a in attrs]
    return [name for _, name in sorted(slots)]


def slice_features(
    frame: DataFrame, names: Sequence[str], features: str = "features", out: str = "selected"
) -> DataFrame:
    """Keep the slots with these names, in this order."""
    return VectorSlicer(inputCol=features, outputCol=out, names=list(names)).transform(frame)


def split_part(key: str, train_tenths: int = 7, seed: int = 42) -> Column:
    """``train`` or ``test`` by the key's hash, the same however the table is partitioned."""
    return F.when(split_bucket(key, seed) < train_tenths, "train").otherwise("test")


def split_by_key(
    rows: DataFrame, key: str, train_tenths: int = 7, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Disjoint training and test rows that together are all rows."""
    part = split_part(key, train_tenths, seed)
    return rows.where(part == "train"), rows.where(part == "test")
