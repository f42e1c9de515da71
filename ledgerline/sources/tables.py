"""Parquet tables, SQL names and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` available to SQL under ``name`` for this session."""
    df.createOrReplaceTempView(name)
    return df


def preview(df: DataFrame, key: str, rows: int = 20) -> DataFrame:
    """The first ``rows`` rows by ``key``; a top-k per task, not a full sort."""
    return df.orderBy(key).limit(rows)
