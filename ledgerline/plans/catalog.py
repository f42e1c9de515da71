"""All queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans import (
    columns,
    evaluation,
    features,
    forests,
    imputation,
    model_properties,
    models,
    profiles,
    reports,
)

SECTIONS = [columns, reports, profiles, imputation, evaluation, features, models, model_properties, forests]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for section in SECTIONS for name, query in section.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for section in SECTIONS for name, text in section.ORACLE.items()}
