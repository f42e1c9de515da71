"""WARC archives with a Zstandard dictionary, and the reader for them.

Each archive opens with a skippable frame that embeds the dictionary, built from records of that
archive; every record is a frame of its own, compressed with it. A page whose payload another page
repeats is written as a revisit of that one, without payload.

Files get a name of their own per attempt, and only those that a finished task reports count: an
attempt that is lost leaves a file that no reader opens. Null html is an empty payload; a null url
leaves the target out; a null page_id is written as such and is never the page that others revisit
unless all are null. Rows of the same payload and page_id are all kept. Extra columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import read, shared_folder, stored

MIN_REVISIT_BYTES = 1000
#: Record bytes that close an archive; a longer record makes a longer archive.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of an archive's records, evenly spaced, that its dictionary is built from.
SAMPLE_BYTES = 2 << 20
LEVEL = 3

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

ARCHIVE = "archive string, n_records long, n_bytes long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def open_folder(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that executors share, and the path in it."""
    scheme, _, path = url.partition(":")
    if not path or scheme == "file":
        return fs.LocalFileSystem(), "/" + (path or url).lstrip("/")
    return fs.FileSystem.from_uri(url)


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on evenly spaced records; where they are too few to train on, made of their bytes."""
    total = sum(map(len, records))
    sample = records[:: max(1, -(-total // SAMPLE_BYTES))]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total // 8)), sample, k=64, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, keeper: int | None) -> bytes:
    """A response, or a revisit of the response of page ``keeper``."""
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": name(page_id),
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if keeper is None:
        return record("response", headers, http + payload)
    return record("revisit", headers | {"WARC-Refers-To": name(keeper), "WARC-Profile": REVISIT_PROFILE}, http)


def pack(records: list[bytes]) -> bytes:
    """One archive: the dictionary in a skippable frame, then a frame a record."""
    made = dictionary(records)
    held = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
    one = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
    about = record("warcinfo", {"WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(held)), held, *(one.compress(r) for r in [about, *records])])


def unpack(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    magic, length = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    held = archive[8 : 8 + length]
    if held[:4] == zstandard.FRAME_HEADER:
        held = zstandard.ZstdDecompressor().decompress(held)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).stream_reader(
        memoryview(archive)[8 + length :], read_across_frames=True
    )
    lines = io.BufferedReader(reader, 1 << 16)
    while lines.readline():
        headers = {}
        while (line := lines.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = lines.read(size)
        if len(block) != size or lines.read(4) != b"\r\n\r\n":
            raise ValueError("record cut short")
        yield headers, block


def with_keepers(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with payload, SHA-1, size and, for revisits, the page that holds the payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    held = held.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    # Payloads are repeated if a digest and size occur twice; one row a digest and task is moved.
    keepers = (
        held.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    found = held.join(keepers, ["digest", "size"], "left")
    return found.withColumn("keeper", F.when(F.col("page_id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper")))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` below ``folder``; one row per archive that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)

        def close(records: list[bytes]) -> pa.RecordBatch:
            packed = pack(records)
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(packed)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64()), pa.array([len(packed)], pa.int64())], ["archive", "n_records", "n_bytes"])

        records, total = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "size", "keeper")), strict=True):
                records.append(page_record(*(x.as_py() for x in row)))
                total += len(records[-1])
                if total >= archive_bytes:
                    yield close(records)
                    records, total = [], 0
        if records:
            yield close(records)

    return stored(with_keepers(pages).mapInArrow(run, ARCHIVE))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The page records of the archives that ``archives`` names; digests and sizes are those of the payloads read."""

    def page(name: str | None) -> int | None:
        found = (name or "").removeprefix("<urn:x-page:").rstrip(">")
        return int(found) if found else None

    def row(headers: dict[str, str], block: bytes) -> tuple:
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        if headers["WARC-Type"] == "response":
            size = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
        else:
            payload = None
        return page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], size, digest, page(headers.get("WARC-Refers-To")), payload

    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with system.open_input_file(f"{base}/{name}") as file:
                    packed = file.read()
                rows = []
                for headers, block in unpack(packed):
                    if headers["WARC-Type"] in ("response", "revisit"):
                        rows.append(row(headers, block))
                    if len(rows) >= 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    # Archives are dealt out by name: the list of them is short, their contents are not.
    tasks = archives.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return archives.repartition(int(tasks), "archive").mapInArrow(run, RECORD)


def op2_warc(spark, folder: str) -> DataFrame:
    to = shared_folder(spark)
    archives = write_archives(read(spark, folder, "pages"), to)
    return read_archives(archives, to).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
