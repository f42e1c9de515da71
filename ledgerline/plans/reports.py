"""Count reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import last_segment
from ledgerline.operators.reports import band, count_report, numbered, report_order, sql_report, value_counts
from ledgerline.sources import read_table, register

BY_THREE_KEYS = """
    select l_linestatus, l_quantity, l_linenumber, count(*) as n
    from {table}
    where l_returnflag = 'R'
    group by l_linestatus, l_quantity, l_linenumber
    order by n desc, l_linestatus, l_quantity, l_linenumber"""


def by_class(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    return count_report(orders, ["o_orderpriority"], F.col("o_orderstatus") == "F")


def by_flag(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    return count_report(lineitem, ["l_linestatus"], F.col("l_returnflag") == "R")


def by_numeric(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    return count_report(lineitem, ["l_quantity"], F.col("l_returnflag") == "R")


def by_three_keys(spark: SparkSession, folder: str) -> DataFrame:
    register(read_table(spark, folder, "lineitem"), "ledgerline_lineitem")
    return sql_report(spark, BY_THREE_KEYS.format(table="ledgerline_lineitem"))


def by_segment(spark: SparkSession, folder: str) -> DataFrame:
    """Secure pages by the last piece of their address; an address with a query has no such key."""
    pages = read_table(spark, folder, "pages").select(
        F.when(~F.col("url").contains("?"), last_segment("url", "/", "&")).alias("segment"),
        F.col("url").startswith("https:").alias("secure"),
    )
    return count_report(pages, ["segment"], F.col("secure"), largest_first=True)


def by_source(spark: SparkSession, folder: str) -> DataFrame:
    return value_counts(read_table(spark, folder, "documents"), "source")


def by_band(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem").select(
        "l_linestatus", "l_returnflag", band("l_quantity", 10).cast("int").alias("quantity_band")
    )
    keys = ["quantity_band", "l_linestatus"]
    return count_report(lineitem, keys, F.col("l_returnflag") == "R")


#: Reports with an order: their keys, and whether the largest count comes first.
ORDERED = {
    "report_by_class": (by_class, ["o_orderpriority"], False),
    "report_by_flag": (by_flag, ["l_linestatus"], False),
    "report_by_numeric": (by_numeric, ["l_quantity"], False),
    "report_by_three_keys": (by_three_keys, ["l_linestatus", "l_quantity", "l_linenumber"], True),
    "report_by_segment": (by_segment, ["segment"], True),
    "report_by_band": (by_band, ["quantity_band", "l_linestatus"], False),
}


def _numbered(report, keys: list[str], largest_first: bool):
    return lambda spark, folder: numbered(report(spark, folder), report_order(keys, largest_first=largest_first))


QUERIES = {
    "report_by_class": by_class,
    "report_by_flag": by_flag,
    "report_by_numeric": by_numeric,
    "report_by_three_keys": by_three_keys,
    "report_by_segment": by_segment,
    "value_counts": by_source,
    "report_by_band": by_band,
} | {f"{name}_positions": _numbered(*ordered) for name, ordered in ORDERED.items()}

ORACLE = {
    "report_by_class": """
        select o_orderpriority, count(*) as n
        from orders where o_orderstatus = 'F' group by o_orderpriority""",
    "report_by_flag": """
        select l_linestatus, count(*) as n
        from lineitem where l_returnflag = 'R' group by l_linestatus""",
    "report_by_numeric": """
        select l_quantity, count(*) as n
        from lineitem where l_returnflag = 'R' group by l_quantity order by l_quantity""",
    "report_by_three_keys": BY_THREE_KEYS.format(table="lineitem"),
    "report_by_segment": """
        select case when not contains(url, '?')
                    then string_split(string_split(url, '/')[-1], '&')[-1] end as segment,
               count(*) as n
        from pages where starts_with(url, 'https:') group by 1 order by n desc, segment""",
    "value_counts": "select source, count(*) as n from documents group by source",
    "report_by_band": """
        select cast(floor(l_quantity / 10) * 10 as integer) as quantity_band, l_linestatus,
               count(*) as n
        from lineitem where l_returnflag = 'R' group by 1, 2""",
}

for _name, (_, _keys, _largest) in ORDERED.items():
    _order = ", ".join([*(["n desc"] if _largest else []), *[f"{k} asc nulls first" for k in _keys]])
    ORACLE[f"{_name}_positions"] = f"select *, row_number() over (order by {_order}) as position from ({ORACLE[_name]})"
