"""Sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import (
    array_item,
    bucket_other,
    last_segment,
    segment_count,
    select_except,
    token_after_comma,
    typed_projection,
)
from ledgerline.operators.reports import value_counts
from ledgerline.session import shared_path
from ledgerline.sources import (
    preview,
    read_csv_inferred,
    read_csv_text,
    read_table,
    write_csv,
    write_report,
)

ORDER_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderday": "string",
    "o_orderpriority": "string",
}


def blanked_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with every 17th key's price missing: the table itself has no gaps."""
    kept = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice"))
    return read_table(spark, folder, "orders").withColumn("o_totalprice", kept)


def _orders_by_day(orders: DataFrame) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderday")
    return orders.select(*[c if c != "o_orderday" else day for c in ORDER_TYPES])


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "orders")
    write_csv(_orders_by_day(read_table(spark, folder, "orders")), path)
    return typed_projection(read_csv_text(spark, path), ORDER_TYPES)


def csv_text_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with line breaks, quotes and commas, written and read back."""
    path = shared_path(spark, "documents")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    write_csv(read_table(spark, folder, "documents").select(*names), path)
    text = read_csv_text(spark, path, columns=names, multi_line=True)
    types = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return typed_projection(text, types)


def csv_inferred_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Types inferred beside a text column with line breaks."""
    path = shared_path(spark, "csv-breaks")
    write_csv(read_table(spark, folder, "documents").select("doc_id", "n_chars", "text"), path)
    found = read_csv_inferred(spark, path, multi_line=True)
    return found.select("doc_id", "n_chars", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


def csv_na_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "orders-na")
    write_csv(_orders_by_day(blanked_orders(spark, folder)), path, missing="NA")
    text = read_csv_text(spark, path, columns=list(ORDER_TYPES), missing="NA")
    return typed_projection(text, ORDER_TYPES)


def csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Types are found by reading; each row names the type its price was given."""
    path = shared_path(spark, "orders-inferred")
    write_csv(_orders_by_day(blanked_orders(spark, folder)), path, missing="NA")
    inferred = read_csv_inferred(spark, path)
    return inferred.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        "o_orderpriority",
        "o_totalprice",
        F.typeof("o_totalprice").alias("price_type"),
        F.typeof("o_orderpriority").alias("priority_type"),
    )


def report_export(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select(
        last_segment("url", "/", "&").alias("segment")
    )
    path = shared_path(spark, "report")
    write_report(value_counts(pages, "segment").orderBy(F.desc("n"), "segment"), path)
    text = read_csv_text(spark, path, columns=["segment", "n"])
    return typed_projection(text, {"segment": "string", "n": "bigint"})


def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    return preview(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", 20)


def typed_columns(spark: SparkSession, folder: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice").cast("string"))
    text = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_key"),
        F.coalesce(price, F.lit("NA")).alias("price"),
        F.coalesce(price, F.lit("NA")).alias("whole_price"),
        F.col("o_orderpriority").alias("not_a_number"),
        F.col("o_orderstatus").alias("status"),
    )
    return typed_projection(
        text,
        {
            "order_key": "bigint",
            "price": "double",
            "whole_price": "int",
            "not_a_number": "int",
            "status": "string",
        },
    )


def drop_rename(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return (
        part.withColumn("short", array_item("p_name", " ", 0))
        .drop("p_name")
        .withColumnRenamed("short", "p_name")
    )


def select_all_but(spark: SparkSession, folder: str) -> DataFrame:
    return select_except(read_table(spark, folder, "customer"), ["c_name", "c_nationkey"])


def last_segments(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", last_segment("url", "/", "&").alias("segment"))


def split_size(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    pieces = segment_count("url", "/")
    return pages.select("page_id", pieces.alias("n_pieces"), (pieces - 1).alias("last_index"))


def array_get(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part")
    return part.select(
        "p_partkey",
        array_item("p_name", " ", 1).alias("second"),
        array_item("p_name", " ", 5).alias("sixth"),
    )


def tokens_after_comma(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return documents.select("doc_id", token_after_comma("text").alias("token"))


def buckets(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    kind = bucket_other("event_type", ["view", "click"])
    return events.select("event_id", kind.alias("event_kind"))


def filter_and(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    both = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")
    return lineitem.where(both).select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_extendedprice"
    )


def null_skipping(spark: SparkSession, folder: str) -> DataFrame:
    return (
        blanked_orders(spark, folder)
        .groupBy("o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("o_totalprice").alias("n_prices"),
            F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
            F.min("o_totalprice").alias("min_price"),
            F.max("o_totalprice").alias("max_price"),
        )
    )


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "csv_text_roundtrip": csv_text_roundtrip,
    "csv_na_scan": csv_na_scan,
    "csv_inferred_breaks": csv_inferred_breaks,
    "csv_inferred": csv_inferred,
    "report_export": report_export,
    "preview_rows": preview_rows,
    "typed_projection": typed_columns,
    "drop_rename": drop_rename,
    "select_except": select_all_but,
    "last_segment": last_segments,
    "split_size": split_size,
    "array_get": array_get,
    "token_after_comma": tokens_after_comma,
    "bucket_other": buckets,
    "filter_and": filter_and,
    "null_skipping_agg": null_skipping,
}

_BY_DAY = """
    select o_orderkey, o_custkey, o_orderstatus, {price} as o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d') as o_orderday, o_orderpriority
    from orders"""

BLANKED_PRICE = "case when o_orderkey % 17 <> 0 then o_totalprice end"

_SEGMENT = "string_split(string_split(url, '/')[-1], '&')[-1]"

ORACLE = {
    "csv_text_roundtrip": "select doc_id, text, lang, source, n_chars from documents",
    "csv_inferred_breaks": "select cast(doc_id as integer) as doc_id, cast(n_chars as integer) as n_chars, length(text) as n, md5(text) as digest from documents",
    "csv_roundtrip": _BY_DAY.format(price="o_totalprice"),
    "csv_na_scan": _BY_DAY.format(price=BLANKED_PRICE),
    "csv_inferred": f"""
        select o_orderkey, o_orderpriority, {BLANKED_PRICE} as o_totalprice,
               'double' as price_type, 'string' as priority_type
        from orders""",
    "report_export": f"""
        select nullif({_SEGMENT}, '') as segment, count(*) as n
        from pages group by {_SEGMENT}""",
    "preview_rows": """
        select o_orderkey, o_orderstatus, o_totalprice
        from orders order by o_orderkey limit 20""",
    "typed_projection": f"""
        select o_orderkey as order_key, {BLANKED_PRICE} as price,
               cast(trunc({BLANKED_PRICE}) as integer) as whole_price,
               try_cast(o_orderpriority as integer) as not_a_number, o_orderstatus as status
        from orders""",
    "drop_rename": """
        select p_partkey, p_brand, p_type, string_split(p_name, ' ')[1] as p_name from part""",
    "select_except": "select * exclude (c_name, c_nationkey) from customer",
    "last_segment": f"select page_id, {_SEGMENT} as segment from pages",
    "split_size": """
        select page_id, cast(len(string_split(url, '/')) as integer) as n_pieces,
               cast(len(string_split(url, '/')) - 1 as integer) as last_index
        from pages""",
    "array_get": """
        select p_partkey, string_split(p_name, ' ')[2] as second,
               string_split(p_name, ' ')[6] as sixth
        from part""",
    "token_after_comma": """
        select doc_id, string_split(string_split(text, ',')[2], ' ')[2] as token
        from documents""",
    "bucket_other": """
        select event_id,
               case when event_type in ('view', 'click') then event_type else 'Other' end
                   as event_kind
        from events""",
    "filter_and": """
        select l_orderkey, l_linenumber, l_linestatus, l_returnflag, l_extendedprice
        from lineitem where l_linestatus = 'O' and l_returnflag = 'R'""",
    "null_skipping_agg": f"""
        select o_orderstatus, count(*) as n_rows, count(p) as n_prices,
               round(avg(p), 4) as mean_price, min(p) as min_price, max(p) as max_price
        from (select o_orderstatus, {BLANKED_PRICE} as p from orders)
        group by o_orderstatus""",
}
