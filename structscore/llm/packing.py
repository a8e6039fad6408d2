"""Packing along a space-filling curve.

A document's ids are hashed into a vector, projected to three dimensions and
numbered along a Hilbert curve.  The small table (curve key, document, length)
is range-sorted by that key; running totals inside each partition plus the
partitions' own totals (one number each) give every document its place in one
endless line of tokens, which is cut every `length` tokens.  Sequences are full
but for the last; neighbours on the curve share sequences.  Ids move once, to
meet their places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, text_bytes
from .tokens import VOCABULARY, encoder

BUCKETS, DIMENSIONS, BITS = 1024, 3, 10

TOKENS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("curve", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of cell coordinates along the Hilbert curve.

    J. Skilling, "Programming the Hilbert curve" (2004): undo excess work from
    the top bit down, Gray-encode, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Curve keys of documents: hashed log counts, unit length, fixed projection."""
    plane = np.random.default_rng(0).standard_normal((BUCKETS, DIMENSIONS))
    keys = []
    for i in range(0, len(ids), 256):
        part = ids[i : i + 256]
        flat = np.concatenate(part).astype(np.uint32)
        bucket = (flat * np.uint32(2654435761)) >> np.uint32(22)
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
        counts = np.bincount(owner * BUCKETS + bucket, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS)
        v = np.log1p(counts)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        cells = np.clip((v @ plane + 4) * (1 << BITS) / 8, 0, (1 << BITS) - 1)
        keys.append(hilbert_index(cells.astype(np.int64)))
    return np.concatenate(keys)


def tokenised(documents: DataFrame, vocabulary: str = VOCABULARY, end: int = 1) -> DataFrame:
    """doc_id, curve key, number of ids and the ids of every row, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = encoder(vocabulary).encode(batch.column("text"), end)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(curve_keys(ids)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                ],
                names=[f.name for f in TOKENS],
            )

    return documents.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, TOKENS)


def places(rows: DataFrame) -> DataFrame:
    """(row, place): how many ids stand before each row in curve order.

    `rows` has row, curve, doc_id and n.  Order: curve key, doc_id, row number.
    """
    order = ["curve", "doc_id", "row"]
    line = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n").withColumn("part", F.spark_partition_id()).checkpoint()
    totals = {r.part: r.n for r in line.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number a partition
    before: dict[int, int] = {}
    n = 0
    for part in sorted(totals):
        before[part] = n
        n += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = before[batch.column("part")[0].as_py()]
            ends = at + np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(([at], ends[:-1])))], names=["row", "place"])
            at = int(ends[-1])

    return line.mapInArrow(run, "row bigint, place bigint")


def pack(documents: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY, end: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document in a sequence.

    Null and empty texts are their end id alone; repeated rows are packed each;
    an empty table has no pieces.  `ids` are little-endian, two bytes each (four
    for vocabularies beyond 65,536 ids).
    """
    rows = stored(tokenised(documents, vocabulary, end).withColumn("row", F.monotonically_increasing_id()), "tokens")
    placed = rows.select("row", "doc_id", "n", "ids").join(places(rows.select("row", "curve", "doc_id", "n")), "row")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = T.StructType([T.StructField(n, T.LongType()) for n in names] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            found: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n", "place", "ids")]
            for doc, n, place, raw in zip(*columns, strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}")
                start = 0
                while start < n:
                    at = place + start
                    size = min(n - start, length - at % length)
                    piece = ids[start : start + size]
                    found.append((doc, start, size, zlib.crc32(piece.astype("<u4").tobytes()), n, at // length, at % length, piece.tobytes()))
                    start += size
            if found:
                columns = list(zip(*found, strict=True))[: len(out)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if f.name == "ids" else pa.int64()) for c, f in zip(columns, out, strict=True)], names=out.fieldNames()
                )

    return placed.select("doc_id", "n", "place", "ids").mapInArrow(run, out)
