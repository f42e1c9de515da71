"""Line-first cleaning: lines fail rules one by one, and a document that loses too much text is rejected.

DataFrame functions only. Everything about a document is computed inside its row, so nothing is
shuffled and no group can grow hot. Nulls count as empty texts, which have no words and fail the
base rule; repeated rows are judged one by one; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import WORD_SPACE, read

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document is rejected if its failed lines hold more than this share of its word characters.
MAX_LOST_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"

# Phrases of lines that pages carry besides their text.
BOILERPLATE = [
    "accept all cookies",
    "we use cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "javascript is disabled",
    "all rights reserved",
    "click here to",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "follow us on",
    "share this article",
    "lorem ipsum",
]


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SPACE + "+"), "")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words_of(text), "")).cast("long")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of ``size`` words that the array holds twice or more.

    Windows are told apart by 64-bit hashes within one text: a false match needs two windows of
    the same text to collide. Only texts with a repeated hash sort their windows.
    """

    def window(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - size)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))

    def repeated_starts(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(placed: Column) -> Column:
            near = lambda p, k: F.coalesce(F.get(placed, k)["h"] == p["h"], F.lit(False))
            kept = F.filter(placed, lambda p, k: near(p, k + 1) | ((k > 0) & near(p, F.greatest(k - 1, F.lit(0)))))
            return F.array_sort(F.transform(kept, lambda p: p["i"]))

        return bound(placed, twins)

    def covered(starts: Column) -> Column:
        step = lambda s, k: F.least(F.lit(size), F.coalesce(F.get(starts, k + 1) - s, F.lit(size)))
        return F.aggregate(F.transform(starts, step), F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            bound(repeated_starts(hashes), covered)
        )

    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(
        bound(words, lambda w: bound(window(w), count))
    )


def line_fails(line: Column) -> Column:
    """Whether one line breaks the rules for punctuation, navigation or boilerplate.

    Punctuation: symbols or marks make up over a tenth of its word characters, or three words and
    more end in doubled marks. Navigation: three and more parts of a few words between bars or
    arrows. Shouting: most letters of five and more words are capitals. Boilerplate: it holds one
    of the fixed phrases.
    """
    chars = F.length(F.regexp_replace(line, WORD_SPACE + "+", ""))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&<>=^~_\\{}]")) * 10 > chars
    doubled = F.regexp_count(line, F.lit(r"(?:!!|\?\?|\.\.\.)(?:" + WORD_SPACE + "|$)")) >= 3
    bars = F.regexp_count(line, F.lit(WORD_SPACE + r"[|»›·•]+(?:" + WORD_SPACE + "|$)"))
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    navigation = (bars >= 2) & (bars * 5 >= words - bars)
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    shouting = (words >= 5) & (capitals * 10 > chars * 6)
    phrase = F.lower(line).rlike("|".join(BOILERPLATE))
    return symbols | doubled | navigation | shouting | phrase


def _judged(docs: DataFrame, max_lost_percent: int) -> DataFrame:
    """``judge`` with each row of ``docs`` as struct ``row`` beside it."""
    split = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select(
        "row",
        "doc_id",
        "text",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = split.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        F.array_distinct("lines").alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    cleaned = counted.select(
        "*",
        (F.col("n_lines") - F.size("lines")).cast("long").alias("n_dup_lines"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("clean_lines"),
    )
    lost = F.col("word_chars") - F.length(F.array_join(words_of(F.array_join("clean_lines", "\n")), ""))
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return cleaned.select(
        "row",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        lost.cast("long").alias("lost_chars"),
        F.array_join("clean_lines", "\n").alias("clean_text"),
    ).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("word_chars")))


def judge(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, ``base_failed``, ``lost_chars``, ``clean_text``, ``kept``.

    Lines that fail, and lines that repeat an earlier one of the document, are lost.
    """
    return _judged(docs, max_lost_percent).drop("row")


def kept_documents(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return _judged(docs, max_lost_percent).where("kept").select("row.*")


def op7_line_rules(spark, folder: str) -> DataFrame:
    return judge(read(spark, folder, "documents")).drop("clean_text")
