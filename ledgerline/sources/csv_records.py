"""CSV records whose quoted values hold line breaks, read in byte ranges.

A line break ends a record if an even number of quotes stands before it in its file. Ranges are
Spark's own splits of a text file. The quotes of every range are counted, and the parity of all
earlier ranges tells each range whether it starts inside a quoted value. Ranges then put their lines
together to records on their own; what is left of records that lie across ranges, at most two pieces
a range, is put together by a small group each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PIECE = "file string, block long, place long, part string, text string"
#: What a piece is: a whole record, the end of an earlier range's record, the start of one that goes
#: on in later ranges, or a range that lies in one record altogether.
WHOLE, END, START, MIDDLE = "whole", "end", "start", "middle"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of records from lines in order; ``odd`` is the parity before a range."""
    here, held, odd, began, place, out = None, [], False, False, 0, []

    def closed() -> Iterator[tuple]:
        """What is still open at the end of a range."""
        if here is not None and (odd or began):
            yield (*here, place, MIDDLE if began else START, "\n".join(held))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = zip(*found, strict=True) if found else ([],) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "place", "part", "text"])

    for batch in batches:
        for file, block, odd_before, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != here:
                out += closed()
                here, held, odd, place = (file, block), [], odd_before, 0
                began = odd  # inside a record of an earlier range
            held.append(value)
            odd ^= value.count('"') % 2 == 1
            if not odd:
                out.append((*here, place, END if began else WHOLE, "\n".join(held)))
                held, began, place = [], False, place + 1
        if len(out) > 10_000:
            yield rows(out)
            out = []
    yield rows([*out, *closed()])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place, text: every record of the files at ``path``; blank lines are none.

    ``block`` and ``place`` are in the order of the file.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # A row a range.
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) % 2 == 1).alias("odd"))
    # Only a broadcast keeps the lines of a range in order; a million ranges are some 100 MB of text files' names.
    pieces = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "odd", "value").mapInArrow(_pieces, _PIECE)
    whole = pieces.where(F.col("part") == WHOLE).select("file", "block", "place", "text")
    across = pieces.where(F.col("part") != WHOLE)
    # A record across ranges starts with its START piece and runs to the next END of its file.
    so_far = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = across.withColumn("record", F.count_if(F.col("part") == START).over(so_far))
    joined = numbered.groupBy("file", "record").agg(
        F.min(F.struct("block", "place")).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    found = whole.unionByName(joined.select("file", F.col("at.block").alias("block"), F.col("at.place").alias("place"), "text"))
    return found.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")
