"""CSV in and out."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.csv_records import read_records

# Quotes inside a quoted value are doubled, as R and spreadsheets write them.
QUOTING = {"header": True, "quote": '"', "escape": '"'}
#: Stands for null while reading; no value of a text file equals it.
NOTHING = "\0"
BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _reader(spark: SparkSession, missing: str | None) -> DataFrameReader:
    # Nothing at all is null, as is the missing token; an empty value between quotes is text.
    return spark.read.options(**QUOTING, **BLANKS, emptyValue="", nullValue=missing or NOTHING)


def _from_records(spark: SparkSession, path: str, columns: Sequence[str] | None, missing: str | None) -> DataFrame:
    """All columns as text from records that were put together over line breaks."""
    records = read_records(spark, path)
    # The first record of every file is its header.
    heads = records.groupBy("file").agg(F.min(F.struct("block", "place", "text")).alias("head"))
    if columns is None:
        first = heads.orderBy("file").first()
        if first is None:
            raise ValueError(f"no header in {path}")
        columns = next(csv.reader([first["head"]["text"]]))
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in (QUOTING | BLANKS).items() if k != "header"}
    options |= {"emptyValue": "", "nullValue": missing or NOTHING, "maxCharsPerColumn": "-1"}
    schema = ", ".join(f"`{c}` string" for c in columns)
    rest = records.join(F.broadcast(heads), "file").where(F.struct("block", "place") != F.struct("head.block", "head.place"))
    return rest.select(F.from_csv("text", schema, options).alias("row")).select("row.*")


#: Types of inferred columns, the narrowest first, and how a text of the type looks.
INFERRED = {"int": r"^[+-]?\d+$", "bigint": r"^[+-]?\d+$", "double": r"^\S+$", "date": r"^\d+-\d+-\d+$", "timestamp": r"^\d+-\d+-\d+\D", "boolean": r"(?i)^(true|false)$"}


def _inferred(rows: DataFrame) -> DataFrame:
    """Text columns as the narrowest type that all their values have."""
    fits = lambda c, kind, look: F.bool_and(F.when(F.col(c).isNotNull(), F.col(c).rlike(look) & F.col(c).try_cast(kind).isNotNull()))
    tested = rows.agg(*[fits(f"`{c}`", kind, look).alias(f"{i}:{kind}") for i, c in enumerate(rows.columns) for kind, look in INFERRED.items()]).first()
    kinds = [next((k for k in INFERRED if tested[f"{i}:{k}"]), "string") for i in range(len(rows.columns))]
    return rows.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in zip(rows.columns, kinds, strict=True)])


def _writer(df: DataFrame) -> DataFrameWriter:
    return df.write.options(**QUOTING, **BLANKS)


def read_csv_text(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    missing: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Header CSV with every column as text; ``missing`` is the token read as null.

    Naming ``columns`` saves the job that reads the header. Values with line breaks need
    ``multi_line``, which counts quotes in a pass of its own; files are read in splits all the same.
    """
    if multi_line:
        return _from_records(spark, path, columns, missing)
    reader = _reader(spark, missing)
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def read_csv_inferred(
    spark: SparkSession, path: str, missing: str = "NA", multi_line: bool = False
) -> DataFrame:
    """Header CSV with types inferred by one extra pass over the file."""
    if multi_line:
        return _inferred(_from_records(spark, path, None, missing))
    return _reader(spark, missing).option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, missing: str = "") -> None:
    """Header CSV, one file per task, without a row-number column.

    Empty text is written as ``""``, so it differs from a null written as nothing.
    """
    _writer(df).option("nullValue", missing).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV: blanks at the ends of a key are kept, a null or empty key is empty."""
    _writer(df).option("nullValue", "").option("emptyValue", "").csv(path)
