"""Archives, quotation links and the pipeline."""

import hashlib
import os
import random
import struct

import brute
import pytest
import zstandard
from compare import open_tables, spark_rows, spark_types, sql_rows, sql_types

import __spark_entry__
import corpus_pipeline
from ledgerline.llm import catalog, pii, quote_links, warc
from ledgerline.llm.decontaminate import normalised
from ledgerline.llm.quality_rules import judge
from ledgerline.llm.quote_links import chat_text, reply_ordered
from ledgerline.llm.sql import ORACLE

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    tables = open_tables(FOLDER)
    made = catalog.queries()[name](spark, FOLDER)
    assert spark_types(made) == sql_types(tables, ORACLE[name])
    assert spark_rows(made) == sql_rows(tables, ORACLE[name])


def pages():
    long = "<p>" + "é long page " * 200
    rows = [(1, "http://a/b c", long), (2, None, long), (3, "u", long + "!"), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short")]
    return rows + [(9, "u\r\nX: y", long), (9, "u", long), (None, "u", long), (None, None, "n" * 2000), (12, "u", "x" * 100_000)]


def test_archives_round_trip(spark, tmp_path):
    rows = pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as size", "'y' as digest", "2 as keeper")
    archives = warc.write_archives(table, str(tmp_path / "out"), archive_bytes=5000)
    made = warc.read_archives(archives, str(tmp_path / "out")).collect()
    text = lambda h: (h or "").encode()
    keepers = {}
    for p, _, h in rows:
        if len(text(h)) >= 1000 and p is not None:
            keepers[h] = max(p, keepers.get(h, p))
    expected = []
    for p, _, h in rows:
        revisit = h in keepers and p != keepers[h]
        expected.append((p, len(text(h)), hashlib.sha1(text(h)).hexdigest(), "revisit" if revisit else "response", keepers[h] if revisit else None))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in made), key=repr) == sorted(expected, key=repr)
    assert sorted(bytes(r.payload) for r in made if r.record_type == "response") == sorted(text(h) for (_, _, h), e in zip(rows, expected) if e[3] == "response")


def test_archives_open_with_a_dictionary_frame(spark, tmp_path):
    table = spark.createDataFrame(pages(), "page_id long, url string, html string")
    (one,) = warc.write_archives(table.coalesce(1).repartition(1), str(tmp_path), archive_bytes=1 << 30).select("archive").distinct().collect()[:1]
    packed = open(os.path.join(tmp_path, one.archive), "rb").read()
    magic, size = struct.unpack_from("<II", packed)
    assert magic == 0x184D2A5D
    made = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed[8 : 8 + size]))
    first = zstandard.ZstdDecompressor(dict_data=made).decompressobj()
    assert first.decompress(packed[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")  # one frame, one record
    assert first.unused_data[:4] == zstandard.FRAME_HEADER
    assert warc.write_archives(table.limit(0), str(tmp_path)).collect() == []


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are  you?"),
        (1, 1, "assistant", "On Monday X wrote:\n> hello there.\n> How are you?\nFine, thanks."),
        (1, 2, "user", "> On Monday X wrote:\n> > Hello there.\n> Fine, thanks.\nGood."),
        (1, 3, "user", "Other topic"),
        (1, 4, "assistant", "> How are you?\nAgain fine"),
        (1, 5, "x", None),
        (None, 0, "user", "a"),
        (None, 1, None, ">a\nb"),
        (1, None, "user", ">Good."),
        (2, 0, "user", "> Good.\nno origin"),
        (2, 0, "user", "> Good.\nno origin"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as level", "'x' as unit", "0 as lines")
    made = chat_text(reply_ordered(table)).collect()
    found = [(r.conv_id, r.turn, r.text, r.quote_depth, r.reply_to, r.thread, r.depth) for r in made]
    assert found == [
        (None, 0, "a", 0, None, 0, 0),
        (None, 1, "b", 1, 0, 0, 1),
        (1, None, "", 1, None, None, 0),
        (1, 0, "Hello there.\nHow are  you?", 0, None, 0, 0),
        (1, 1, "Fine, thanks.", 1, 0, 0, 1),
        (1, 2, "Good.", 2, 1, 0, 2),
        (1, 4, "Again fine", 1, 0, 0, 1),
        (1, 3, "Other topic", 0, None, 3, 0),
        (1, 5, "", 0, None, 5, 0),
        (2, 0, "no origin", 1, None, 0, 0),
        (2, 0, "no origin", 1, None, 0, 0),
    ]
    assert made[1].chat == "<|user|>\nb\n"
    assert reply_ordered(table.limit(0)).collect() == []


def test_long_chains_of_replies(spark):
    rows = [(7, k, "user", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(100)]
    made = reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.reply_to, r.thread, r.depth) for r in made] == [(k, k - 1 if k else None, 0, k) for k in range(100)]


def test_pipeline_stages(spark):
    """Every stage on what the one before kept, against plain versions."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, FOLDER))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == columns
        old = {r.doc_id: r for r in before.collect()}
        assert set(kept[name]) <= set(old)
        if name == "quality_rules":
            assert set(kept[name]) == {r.doc_id for r in judge(before).collect() if r.kept}
        elif name == "ngram_join":
            rows = sorted((d, brute.shingles(r.text)) for d, r in old.items())
            meet = {}
            for d, s in rows:  # only rows that share a shingle can be linked
                for x in s:
                    meet.setdefault(x, []).append(d)
            near = {d for m in meet.values() if len(m) > 1 for d in m}
            few = [(d, s) for d, s in rows if d in near]
            of = dict(zip((d for d, _ in few), brute.components(few)))
            assert set(kept[name]) == {d for d, _ in rows if of.get(d, d) == d}
        elif name == "decontamination":
            text = lambda t: normalised(memoryview_of(t))[0].tobytes().strip()
            held = [text(b) for b in benchmark]
            leaked = {d for d, r in old.items() if any(b in text(r.text) for b in held)}
            assert set(kept[name]) == set(old) - leaked
        elif name == "surrogates":
            assert set(kept[name]) == set(old)
            for d, r in kept[name].items():
                assert r.n_chars == len(r.text)
                assert [x[2] for x in pii.detect(old[d].text)] == [x[2] for x in pii.detect(r.text)]
                assert not {x[2:] for x in pii.detect(old[d].text)} & {x[2:] for x in pii.detect(r.text)}
        else:
            assert set(kept[name]) == set(old) and all(r.n_tokens == len(r.ids) for r in kept[name].values())


def memoryview_of(text):
    import numpy as np

    return np.frombuffer(text.encode(), np.uint8)


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names


def test_replies_stand_under_what_they_answer(spark):
    """Against a plain walk, on random trees, a long chain and a message with many replies."""
    pick = random.Random(12)
    parents = {}
    for conv in range(6):
        for turn in range(1, 60):
            if pick.random() < 0.8:
                parents[conv, turn] = pick.randrange(turn)
    parents |= {(10, t): t - 1 for t in range(1, 150)} | {(11, t): 0 for t in range(1, 150)} | {(None, t): t // 2 for t in range(1, 20)}
    links = spark.createDataFrame([(c, t, p) for (c, t), p in parents.items()], "conv_id long, turn long, reply_to long").repartition(5)
    found = {(r.conv_id, r.turn): r.place for r in quote_links.places(quote_links.threads(links)).collect()}
    replies = {}
    for (c, t), p in sorted(parents.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        replies.setdefault((c, p), []).append((c, t))
    expected = {}
    for root in sorted({*replies} - {*parents}, key=str):
        open_, place = [root], 0
        while open_:
            node = open_.pop()
            expected[node] = place
            place += 1
            open_ += reversed(replies.get(node, []))
    assert found == expected
    assert quote_links.places(quote_links.threads(links.limit(0))).collect() == []


def test_branches_do_not_interleave(spark):
    said = ["A question about sorting rows.", "First answer with words.", "Second answer with words."]
    rows = [(1, 0, "user", said[0])]
    rows += [(1, 1, "a", f"> {said[0]}\n{said[1]}"), (1, 2, "b", f"> {said[0]}\n{said[2]}")]
    rows += [(1, 3, "user", f"> {said[1]}\nReply to the first."), (1, 4, "user", f"> {said[2]}\nReply to the second.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = quote_links.reply_ordered(table).collect()
    assert [(r.turn, r.depth, r.place) for r in found] == [(0, 0, 0), (1, 1, 1), (3, 2, 2), (2, 1, 3), (4, 2, 4)]
