"""Keys derived from text columns; all run as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN_CHARACTERS = set(r"\^$.|?*+()[]{}")


def _split(column: Column | str, delimiter: str, pieces: int = -1) -> Column:
    # F.split takes a pattern. Plain delimiters stay as they are, which Java splits faster.
    if PATTERN_CHARACTERS & set(delimiter):
        delimiter = rf"\Q{delimiter}\E"
    return F.split(column, delimiter, pieces)


def last_segment(column: Column | str, outer: str = "/", inner: str = ",") -> Column:
    """Text after the last ``outer``, then after the last ``inner`` in that; blanks stay.

    Null in, null out. A trailing delimiter gives the empty text.
    """
    return F.substring_index(F.substring_index(column, outer, -1), inner, -1)


def segment_count(column: Column | str, delimiter: str) -> Column:
    return F.array_size(_split(column, delimiter))


def array_item(column: Column | str, delimiter: str, index: int) -> Column:
    """The 0-based ``index``-th piece, null when there is none; later pieces are not split."""
    return F.get(_split(column, delimiter, index + 2), index)


def token_after_comma(column: Column | str) -> Column:
    """Second blank-separated token of the piece after the first comma."""
    return array_item(array_item(column, ",", 1), " ", 1)


def bucket_other(column: Column | str, keep: Sequence[str], other: str = "Other") -> Column:
    """Listed values stay; every other value, and null, becomes ``other``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isin(*keep), column).otherwise(F.lit(other))
