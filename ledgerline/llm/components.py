"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long), root being the smallest node it reaches.

    Roots themselves are not listed. Nothing but a count and a checksum reaches the driver; a node
    with many links is aggregated before the shuffle, and its join can be split by adaptive execution.
    """
    links = stored(_small_star(links.where("a <> b").select("a", "b")))
    before = None
    while True:
        # Both stars leave a table alone only if every node is linked to its root and nothing else.
        mark = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        links = stored(_small_star(_large_star(links)))
