"""Feature vectors and splits. Vectors of whole numbers are shown as text."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import segment_count
from ledgerline.operators.features import FeatureEncoder, encode_levels, slice_features, slot_names, split_part
from ledgerline.operators.levels import LevelIndex
from ledgerline.operators.models import index_label
from ledgerline.sources import read_table

NUMBERS = ["n_chars", "n_words"]
CATEGORIES = ["lang", "source"]


def document_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The model columns of documents; the text itself goes no further than its word count."""
    return read_table(spark, folder, "documents").select(
        "doc_id", "n_chars", segment_count("text", " ").alias("n_words"), "lang", "source"
    )


def _vector_text(vector: str) -> Column:
    return F.array_join(F.transform(vector_to_array(vector), lambda x: x.cast("bigint")), ",")


def string_index(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select("doc_id", "lang")
    return LevelIndex.fit(documents, ["lang"]).transform(documents)


def wide_index(spark: SparkSession, folder: str) -> DataFrame:
    """A column with a level for almost every row."""
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    return LevelIndex.fit(pages, ["url"], max_bytes=0).transform(pages).select("page_id", "url_index")


def level_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select("l_partkey", "l_shipdate")
    return LevelIndex.fit(lines, ["l_partkey", "l_shipdate"]).table


def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select("doc_id", "lang")
    indexed = LevelIndex.fit(documents, ["lang"]).transform(documents)
    encoded = encode_levels(["lang"]).fit(indexed).transform(indexed)
    return encoded.select("doc_id", "lang", _vector_text("lang_levels").alias("levels"))


def _assembled(spark: SparkSession, folder: str) -> DataFrame:
    documents = document_columns(spark, folder)
    return FeatureEncoder.fit(documents, NUMBERS, CATEGORIES).transform(documents)


def assemble(spark: SparkSession, folder: str) -> DataFrame:
    return _assembled(spark, folder).select("doc_id", _vector_text("features").alias("features"))


def slots(spark: SparkSession, folder: str) -> DataFrame:
    """The vector's slots by number and name, from the table of levels."""
    return FeatureEncoder.fit(document_columns(spark, folder), NUMBERS, CATEGORIES).slots()


def slices(spark: SparkSession, folder: str) -> DataFrame:
    """Character count and the three most frequent languages."""
    assembled = _assembled(spark, folder)
    languages = [s for s in slot_names(assembled) if s.startswith("lang_levels")][:3]
    sliced = slice_features(assembled, ["n_chars", *languages])
    return sliced.select("doc_id", _vector_text("selected").alias("selected"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "labels").select("doc_id", "quality")
    return index_label(rows, "quality")


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    return orders.select("o_orderkey", split_part("o_orderkey").alias("part"))


QUERIES = {
    "string_index": string_index,
    "string_index_wide": wide_index,
    "level_table": level_table,
    "feature_slots": slots,
    "one_hot": one_hot,
    "assemble_features": assemble,
    "slice_features": slices,
    "label_index": labels,
    "hash_split": hash_split,
}


def _levels(column: str, table: str = "documents") -> str:
    return f"""
        select {column},
               row_number() over (order by count(*) desc, cast({column} as varchar)) - 1 as place,
               count(*) over () as slots
        from {table} group by {column}"""


def _block(place: str, slots: str) -> str:
    return f"""list_transform(range({slots}), lambda i: case when i = {place} then 1 else 0 end)"""


_JOINED_LEVELS = f"""
    with langs as ({_levels("lang")}), sources as ({_levels("source")}),
    rows as (
        select doc_id, n_chars, len(string_split(text, ' ')) as n_words,
               l.place as lang_place, l.slots as lang_slots,
               s.place as source_place, s.slots as source_slots
        from documents join langs l using (lang) join sources s using (source))"""

ORACLE = {
    "string_index": f"""
        select doc_id, lang, cast(place as double) as lang_index
        from documents join ({_levels("lang")}) using (lang)""",
    "string_index_wide": f"""
        select page_id, cast(place as double) as url_index
        from pages join ({_levels("url", "pages")}) using (url)""",
    "level_table": """
        with cells as (
            select 'l_partkey' as column_name, cast(l_partkey as varchar) as level from lineitem
            union all select 'l_shipdate', cast(l_shipdate as varchar) from lineitem)
        select column_name, level, count(*) as n,
               row_number() over (partition by column_name order by count(*) desc, level) - 1 as place
        from cells where level is not null group by column_name, level""",
    "feature_slots": f"""
        select cast(0 as bigint) as slot, 'n_chars' as name union all select 1, 'n_words'
        union all select 2 + place, 'lang_levels_' || lang from ({_levels("lang")})
        union all select 2 + (select count(distinct lang) from documents) + place, 'source_levels_' || source
        from ({_levels("source")})""",
    "one_hot": f"""
        select doc_id, lang, array_to_string({_block("place", "slots")}, ',') as levels
        from documents join ({_levels("lang")}) using (lang)""",
    "assemble_features": f"""
        {_JOINED_LEVELS}
        select doc_id, array_to_string(list_concat([n_chars, n_words],
            {_block("lang_place", "lang_slots")},
            {_block("source_place", "source_slots")}), ',') as features
        from rows""",
    "slice_features": f"""
        {_JOINED_LEVELS}
        select doc_id, array_to_string(list_concat([n_chars],
            {_block("lang_place", "least(lang_slots, 3)")}), ',') as selected
        from rows""",
    "label_index": f"""
        select doc_id, quality, cast(place as double) as label
        from labels join ({_levels("quality", "labels")}) using (quality)""",
    "hash_split": """
        select o_orderkey,
               case when ('0x' || substr(md5(o_orderkey || ':42'), 1, 8))::bigint % 10 < 7
                    then 'train' else 'test' end as part
        from orders""",
}
