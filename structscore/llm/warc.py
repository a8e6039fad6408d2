"""WARC archives: one gzip member per record, written by Spark and read in sequence.

Payload digests are grouped first: of equal payloads that are long enough, the
one with the largest page id is the response that the others revisit.  Members
go through Spark's text sink, which commits files as it does any table's: a gzip
member ends in the top byte of its length, which is zero below 16 MiB, so that
byte is the sink's line end and the file is a plain series of members.  A row of
that sink is a file, of a set size, however much a task writes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, slices, text_bytes

#: WARC-Date of every record: tables hold no time of capture.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 16

#: A file's bytes, about: a task rolls to its next file then; a longer record is a file of its own.
FILE_BYTES = 32 << 20


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _named(digest) -> str:
    return "sha1:" + base64.b32encode(digest.digest()).decode()


def _digest(data: bytes) -> str:
    return _named(hashlib.sha1(data))


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:x-page:{page_id}")
    lines = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        "WARC-Record-ID: " + record_id(page_id),
        "WARC-Target-URI: " + target,
        "WARC-Date: " + DATE,
        "Content-Type: application/http; msgtype=response",
        "WARC-Payload-Digest: " + _digest(payload),
        "WARC-Block-Digest: " + _digest(block),
        *([] if refers_to is None else ["WARC-Profile: " + PROFILE, "WARC-Refers-To: " + record_id(refers_to)]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def page_id(self) -> int | None:
        return _page(self.headers["warc-record-id"])

    @property
    def refers_to(self) -> int | None:
        return _page(self.headers["warc-refers-to"]) if "warc-refers-to" in self.headers else None


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rsplit(":", 1)[1]
    return None if name == "null" else int(name)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _members(content: memoryview) -> Iterator[Iterator[bytes]]:
    """Each gzip member's inflated data, piece by piece; a member is used up before the next one starts."""
    at = 0

    def pieces() -> Iterator[bytes]:
        nonlocal at
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = z.unconsumed_tail or content[at : at + READ_BYTES]
            if not len(piece):
                raise ValueError("a gzip member is cut off")
            if not z.unconsumed_tail:
                at += len(piece)
            yield z.decompress(piece, READ_BYTES)
        at -= len(z.unused_data)

    while at < len(content):
        own = pieces()
        yield own
        for _ in own:
            pass


def _framed(pieces: Iterator[bytes]) -> Record | None:
    """A record by its headers and Content-Length, digests kept up as pieces come; None for an empty member."""
    start = b""
    for piece in pieces:
        start += piece
        if b"\r\n\r\n" in start:
            break
    if not start:
        return None  # the empty member after a record of 16 MiB or more
    head, mark, rest = start.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    headers = _fields(lines[1:])
    left = int(headers["content-length"])
    block, parts, end = hashlib.sha1(), [], b""
    while True:
        own, over = rest[:left], rest[left:]
        block.update(own)
        parts.append(own)
        left -= len(own)
        end += over
        rest = next(pieces, None)
        if rest is None:
            break
    if left or end != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    if _named(block) != headers["warc-block-digest"]:
        raise ValueError("a block does not match its digest")
    top, _, payload = b"".join(parts).partition(b"\r\n\r\n")
    http = _fields(top.split(b"\r\n")[1:])
    if headers["warc-type"] == "response" and (_digest(payload) != headers["warc-payload-digest"] or len(payload) != int(http["content-length"])):
        raise ValueError("a payload does not match its digest or length")
    return Record(headers, http, payload)


def read_records(content: bytes | memoryview) -> Iterator[Record]:
    """All records of an archive in order; lengths and digests must hold."""
    for pieces in _members(memoryview(content)):
        record = _framed(pieces)
        if record:
            yield record


def with_targets(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload and refers_to: the largest page_id of equal payloads of `least` bytes.

    Rows that repeat the largest id are responses too.  Null ids refer to the
    largest id if there is one.  The groups are aggregated before they meet the
    pages, so one payload on a third of all pages is a single row on that side,
    and adaptive joins split the other.  Short payloads have keys of their own
    that no group has, so that they are spread.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_bytes("html").alias("payload")).withColumn(
        "key", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)).otherwise(F.concat(F.lit("own "), F.xxhash64("page_id", "url", "payload")))
    )
    groups = (
        rows.filter(~F.startswith("key", F.lit("own ")))
        .select("page_id", "key")
        .groupBy("key")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("key").alias("group"), "largest")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return rows.join(groups, F.col("key") == F.col("group"), "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, file_bytes: int = FILE_BYTES) -> None:
    """A record per row of `pages` (null html: an empty payload) in files of about `file_bytes` under `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:
            # the sink adds the last byte
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["members"])

        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                member = _member(write_record(**row))
                if member[-1]:
                    member += _member(b"")
                if held and size + len(member) > file_bytes:
                    yield file()
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield file()

    files = with_targets(pages, least).mapInArrow(run, "members binary")
    files.select(F.col("members").cast("string").alias("members")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


FOUND = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("target_uri", T.StringType()),
    ]
)


def read_archives(spark, path: str) -> DataFrame:
    """What each record says, after its lengths and digests were verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for r in read_records(content.as_buffer()):
                    sha1 = base64.b32decode(r.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    rows.append((r.page_id, int(r.http["content-length"]), sha1, r.kind, r.refers_to, r.headers["warc-target-uri"]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(c, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64())
                            for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)
                        ],
                        names=FOUND.fieldNames(),
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FOUND)


def archive_report(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages to archives and read them back, a row per page.

    A null html is an empty payload, a null page_id an id like others; repeated
    rows are records each; an empty table gives no row.
    """
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, file_bytes=file_bytes)
    return read_archives(pages.sparkSession, path).drop("target_uri")
