"""Choices made by hashing a row's key, so they do not depend on partitioning or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _md5_number(digits: int, *parts: Column | str) -> Column:
    digest = F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def split_bucket(key: Column | str, seed: int, buckets: int = 10) -> Column:
    """A bucket 0..buckets-1 from 32 bits of ``md5(key:seed)``; the same in any SQL engine."""
    return _md5_number(8, key, F.lit(seed)) % buckets


def hash_draw(key: Column | str, *salts: object) -> Column:
    """A 60-bit draw from ``md5(key:salt:...)``."""
    return _md5_number(15, key, *[F.lit(s) for s in salts])
