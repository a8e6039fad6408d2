"""Line dedup over hashes: range-partitioned, sorted within, streamed once.

A line's key is hashed to 16 bytes where the text is; from then on only
(hash, document, positions) move.  They are range-partitioned by hash *and*
document, so a line that a third of all documents hold spreads over many
partitions.  Each partition is streamed in order; what a partition's first and
last key count is gathered from all partitions (two rows each), so that a key
cut by partition borders gets the count it has over all of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, stored, text_bytes, text_hash

#: ASCII white space, stripped at both ends of a line for its key.
SPACE = b" \t\n\r\x0b\x0c"

LINES = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("row_hash", T.LongType()),
        T.StructField("positions", T.BinaryType()),
    ]
)
DROPS = T.StructType(LINES.fields[1:])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None where the key is too short to count."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_hash", "text")), strict=True):
                held: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars and (key := line_key(line, min_chars)):
                        held.setdefault(key, []).append(i)
                rows += [(k, doc, mark, np.array(p, "<u4").tobytes()) for k, p in held.items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=[f.name for f in LINES],
                )

    return run


def _runs(keys: list[bytes]) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


def _documents_in(docs: list, last: object) -> tuple[int, object]:
    """How many documents a sorted run adds after the document `last`."""
    n = 0
    for d in docs:
        if d != last:
            n += 1
            last = d
    return n, last


_NONE = object()


class _Count:
    """Documents of the key at hand, in order of doc_id from the largest down."""

    def __init__(self) -> None:
        self.key, self.first, self.last, self.n = None, None, _NONE, 0


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(partition, key, first and last document, documents) of the first and the last key."""
    first: tuple | None = None
    now = _Count()
    part = 0
    for batch in batches:
        part = batch.column("part")[0].as_py()
        keys, docs = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
        for a, b in _runs(keys):
            if keys[a] != now.key:
                if now.key is not None and first is None:
                    first = (now.key, now.first, now.last, now.n)
                now = _Count()
                now.key, now.first = keys[a], docs[a]
            n, now.last = _documents_in(docs[a:b], now.last)
            now.n += n
    rows = [r for r in (first, (now.key, now.first, now.last, now.n) if now.key is not None else None) if r]
    if rows:
        key, lead, tail, n = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32()), pa.array(key, pa.binary()), pa.array(lead, pa.int64()), pa.array(tail, pa.int64()), pa.array(n, pa.int64())],
            names=["part", "key", "lead", "tail", "n"],
        )


def _stream(least: int, cut: dict[bytes, tuple[int, int | None]]):
    """Drops of each partition; `cut`: documents and largest document of keys cut by borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, top = None, 0, None
        last: object = _NONE
        held: list[tuple] = []  # rows of the key at hand while its count is open: documents under `least`, and the first

        def row_batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[f.name for f in DROPS]
            )

        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("key", "doc_id", "row_hash", "positions")]
            for key, doc, mark, positions in zip(*columns, strict=True):
                if key != now:
                    now, seen, last, held = key, 0, _NONE, []
                    total, top = cut.get(key, (0, doc))
                    if total >= least:
                        seen = least
                if doc != last:
                    seen, last = seen + 1, doc
                if doc == top:
                    continue
                if seen < least:
                    held.append((doc, mark, positions))
                    continue
                if held:
                    out += held
                    held = []
                out.append((doc, mark, positions))
            if out:
                yield row_batch(out)

    return run


def dropped_lines(documents: DataFrame, min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """(doc_id, row_hash, drops): per document with drops the bitmap of dropped lines.

    The bitmap is numpy packbits over the document's lines, zlib-compressed; its
    last set bit is the last dropped line.  A key in fewer documents than
    `min_documents` drops nothing; elsewhere the largest doc_id keeps its lines.
    Null texts are one empty line; rows with one doc_id are one document (each
    keeps its own bitmap); null ids are one document below all others.
    """
    lines = stored(
        documents.select(F.col("doc_id").cast("long"), text_hash().alias("row_hash"), text_bytes().alias("text")).mapInArrow(_hash_lines(min_chars), LINES),
        "lines",
    )
    order = [F.col("key").asc(), F.col("doc_id").desc_nulls_last()]
    ordered = (
        lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    )  # keeps partitions as they are: both passes below see the same borders
    edges = ordered.select("part", "key", "doc_id").mapInArrow(_edges, "part int, key binary, lead bigint, tail bigint, n bigint").collect()
    cut: dict[bytes, tuple[int, int | None]] = {}
    tails: dict[bytes, object] = {}
    for r in sorted(edges, key=lambda r: r.part):  # two rows a partition at most
        key = bytes(r.key)
        n, top = cut.get(key, (0, r.lead))
        cut[key] = (n + r.n - (key in tails and tails[key] == r.lead), top)
        tails[key] = r.tail
    drops = ordered.select("key", "doc_id", "row_hash", "positions").mapInArrow(_stream(min_documents, cut), DROPS)
    packed = drops.groupBy("doc_id", "row_hash").agg(F.collect_set("positions").alias("positions"))
    return packed.mapInArrow(_pack, "doc_id bigint, row_hash bigint, drops binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for parts in batch.column("positions").to_pylist():
            at = np.concatenate([np.frombuffer(p, "<u4") for p in parts])
            bits = np.zeros(int(at.max()) + 1, np.uint8)
            bits[at] = 1
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(maps, pa.binary())], names=["doc_id", "row_hash", "drops"])


def kept_lines(text: bytes, drops: bytes | None) -> tuple[bytes, int, int]:
    """The text without dropped lines, its lines before that, and how many went."""
    lines = text.split(b"\n")
    if not drops:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(drops), np.uint8))[: len(lines)]
    gone = np.flatnonzero(bits)
    keep = np.ones(len(lines), bool)
    keep[gone] = False
    return b"\n".join([lines[i] for i in np.flatnonzero(keep)]), len(lines), len(gone)


def with_drops(documents: DataFrame, drops: DataFrame, mark: str) -> DataFrame:
    """`documents` and their bitmaps, as column `mark`."""
    drops = drops.withColumnsRenamed({"doc_id": mark + "_id", "row_hash": mark + "_hash", "drops": mark})
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(mark + "_id")) & (text_hash() == F.col(mark + "_hash"))
    return documents.join(drops, on, "left").drop(mark + "_id", mark + "_hash")


def line_report(documents: DataFrame, min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is kept, one row per row.

    A null or empty text is one empty line; a null doc_id holds lines like any
    other, and less than all; rows that repeat lose alike; an empty table has no
    rows.  Other columns play no part.
    """
    out = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    both = with_drops(docs, dropped_lines(docs, min_chars, min_documents), "drops").select("doc_id", text_bytes().alias("text"), "drops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [kept_lines(t, d) for t, d in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for _, n, _ in rows], pa.int64()),
                    pa.array([n for _, _, n in rows], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t, _, _ in rows]),
                ],
                names=[f.name for f in out],
            )

    return both.mapInArrow(run, out)


def drop_lines(documents: DataFrame, min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """`documents` with the dropped lines gone from `text`; a null text stays null."""
    schema = documents.schema
    mark = fresh(documents, "_drops")
    both = with_drops(documents, dropped_lines(documents, min_chars, min_documents), mark)
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [
                t if not t or not d else kept_lines(t.encode(), d)[0].decode()
                for t, d in zip(batch.column("text").to_pylist(), batch.column(mark).to_pylist(), strict=True)
            ]
            arrays = [batch.column(f.name) for f in schema]
            arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return both.mapInArrow(run, schema)
