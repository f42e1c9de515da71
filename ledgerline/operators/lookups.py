"""Joining small derived tables to large ones, with the size measured first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import settle

MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def measured(side: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Settle ``side`` and tell whether its rows, as JSON text, stay within ``max_bytes``."""
    stored = settle(side)
    size = stored.agg(F.sum(F.length(F.to_json(F.struct("*"))).cast("bigint"))).first()[0]
    return stored, (size or 0) <= max_bytes


def null_safe_join(rows: DataFrame, side: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a null key meets a null key; the keys come from ``rows``."""
    if not on:
        raise ValueError("a join needs a key")
    renamed = side.withColumnsRenamed({k: f"__side_{k}" for k in on})
    condition = F.lit(True)
    for k in on:
        condition = condition & rows[k].eqNullSafe(renamed[f"__side_{k}"])
    joined = rows.join(renamed, condition, how)
    return joined if how == "left_semi" else joined.drop(*[f"__side_{k}" for k in on])


def attach(
    rows: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join one side row per key to ``rows``: broadcast if it fits, else a shuffle join.

    In the shuffle join a hot key sits on the large side only, where adaptive execution
    splits its partition.
    """
    stored, fits = measured(side, max_bytes)
    return null_safe_join(rows, F.broadcast(stored) if fits else stored, on, how)
