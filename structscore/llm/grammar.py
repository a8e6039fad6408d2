"""Token ids on disk as Re-Pair grammars, shard by shard, in ascending doc_id order.

A shard is a run of documents.  Its ids are replaced pair by pair: the frequent
pairs of adjacent symbols become nonterminals, again and again, until no pair is
frequent or all two-byte symbols are used (four-byte ones where a vocabulary
leaves no two-byte symbols).  A shard stores its rules, the
expansion length of every rule, where each document's symbols start, and the
symbols; a range of a document's ids is decoded by skipping over expansion
lengths, without touching the rest.

Shards are byte frames that end in a zero byte.  Spark's text sink writes them
with a zero byte as line end, so files are written and committed by Spark on
any file system it knows, and retried tasks leave no halves behind.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, slices, stored, text_bytes, text_hash
from .tokens import VOCABULARY, encoder

MAGIC = b"RPG1"
HEADER = struct.Struct("<4sQIIIIIII")  # magic, frame bytes, documents, first nonterminal, rules, symbols, end id, crc, unused

#: Ids in a shard, about; a longer document is a shard of its own.
SHARD_IDS = 1 << 21

#: Shards in a file; a task rolls to its next file then, so a file is read whole in bounded memory.
FILE_SHARDS = 16

#: A pair is frequent from this count on: a rule costs eight bytes, a use saves two.
FREQUENT = 6

MIX = np.uint64(0x9E3779B97F4A7C15)


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of sorted positions, every other one of each run of neighbours."""
    if not len(at):
        return np.zeros(0, bool)
    fresh = np.concatenate(([True], np.diff(at) != 1))
    first = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
    return (at - first) % 2 == 0


def compress(ids: np.ndarray, first: int, end: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: (rules, symbols).  Rule r stands for the two symbols rules[r], as symbol first + r.

    No rule holds `end`, so documents can be decoded one by one.  In a round all
    frequent pairs are counted together and replaced left to right; a pair that
    is left with fewer than two uses gets no rule, and is not tried again.
    """
    # symbols and pairs of them: two and four bytes, or four and eight
    symbol, pair, bits = (np.uint16, np.uint32, 16) if first < 1 << 16 else (np.uint32, np.uint64, 32)
    shift, room = pair(bits), (1 << bits) - first
    s = ids.astype(symbol)
    rules: list[np.ndarray] = []
    useless = np.zeros(0, pair)
    mix, last = pair(MIX >> np.uint64(64 - 2 * bits)) | pair(1), pair(2 * bits - 16)
    used = 0
    while used < room and len(s) > 1:
        keys = s[:-1].astype(pair) << shift | s[1:]
        inner = (s[:-1] != end) & (s[1:] != end)
        ordered = np.sort(keys[inner])
        if not len(ordered):
            break
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(edge, len(ordered)))
        good = np.flatnonzero(counts >= frequent)
        good = good[~np.isin(ordered[edge[good]], useless)]
        if not len(good):
            break
        most = min(room - used, max(room // 4, (room - used) // 2))
        if len(good) > most:
            good = good[np.argpartition(-counts[good], most - 1)[:most]]
        pairs = np.sort(ordered[edge[good]])
        # a small table of hashes finds most positions that hold none of the pairs
        table = np.zeros(1 << 16, bool)
        table[pairs * mix >> last] = True
        maybe = np.flatnonzero(table[keys * mix >> last] & inner)
        found = np.minimum(np.searchsorted(pairs, keys[maybe]), len(pairs) - 1)
        hit = pairs[found] == keys[maybe]
        maybe, found = maybe[hit], found[hit]
        picked = _alternate(maybe)
        at, place = maybe[picked], found[picked]
        uses = np.bincount(place, minlength=len(pairs))
        kept = np.flatnonzero(uses >= 2)
        useless = np.concatenate((useless, pairs[uses < 2]))
        number = np.full(len(pairs), -1, np.int64)
        number[kept] = np.arange(len(kept))
        name = number[place]
        at, name = at[name >= 0], name[name >= 0]
        s[at] = (first + used + name).astype(symbol)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        rules.append(np.stack([pairs[kept] >> shift, pairs[kept] & pair((1 << bits) - 1)], 1).astype(np.uint32))
        used += len(kept)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), s.astype(np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids under each rule; rules only use earlier ones."""
    size = np.ones(first + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist(), first):
        size[r] = size[a] + size[b]
    return size[first:]


def expansions(rules: np.ndarray, first: int) -> list[bytes]:
    """The ids under every symbol, four bytes each; rules only use earlier ones."""
    raw = np.arange(first, dtype="<u4").tobytes()
    out = [raw[i : i + 4] for i in range(0, len(raw), 4)]
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return out


def expand(symbols: np.ndarray, under: list[bytes]) -> np.ndarray:
    """All ids under `symbols`."""
    return np.frombuffer(b"".join(map(under.__getitem__, symbols.tolist())), "<u4")


def write_shard(docs: list[int | None], ids: list[np.ndarray], first: int, end: int) -> bytes:
    """One frame.  Document k's symbols start after the k-th end id."""
    rules, symbols = compress(np.concatenate(ids), first, end)
    wide = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    stops = np.flatnonzero(symbols == end)
    ends = stops + 1 if len(stops) == len(docs) else _document_ends(symbols, rules, first, ids)
    body = b"".join(
        (
            np.array([d is None for d in docs], "u1").tobytes(),
            np.array([0 if d is None else d for d in docs], "<i8").tobytes(),
            np.array([len(x) for x in ids], "<u4").tobytes(),
            ends.astype("<u4").tobytes(),
            rules.astype(wide).tobytes(),
            expansion_lengths(rules, first).astype("<u4").tobytes(),
            symbols.astype(wide).tobytes(),
        )
    )
    return HEADER.pack(MAGIC, HEADER.size + len(body) + 1, len(docs), first, len(rules), len(symbols), end, zlib.crc32(body), 0) + body + b"\0"


def _document_ends(symbols: np.ndarray, rules: np.ndarray, first: int, ids: list[np.ndarray]) -> np.ndarray:
    """Where documents end among the symbols, if texts hold the end id themselves."""
    size = np.concatenate((np.ones(first, np.int64), expansion_lengths(rules, first)))
    return np.searchsorted(np.cumsum(size[symbols]), np.cumsum([len(x) for x in ids])) + 1


class Shard:
    """A frame that was read: its documents' ids, whole or in part."""

    def __init__(self, frame: memoryview):
        magic, size, n, self.first, n_rules, n_symbols, self.end, crc, _ = HEADER.unpack_from(frame)
        body = frame[HEADER.size : size - 1]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("not a shard, or damaged")
        wide = "<u2" if self.first + n_rules <= 1 << 16 else "<u4"
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        null = take("u1", n)
        self.docs = [None if z else d for z, d in zip(null.tolist(), take("<i8", n).tolist(), strict=True)]
        self.counts = take("<u4", n)
        self.ends = take("<u4", n)
        self.rules = take(wide, 2 * n_rules).reshape(-1, 2)
        self.sizes = take("<u4", n_rules)
        self.symbols = take(wide, n_symbols)
        self.under = expansions(self.rules, self.first)

    def all_ids(self) -> list[np.ndarray]:
        """The ids of every document, expanded together."""
        stops = np.cumsum(self.counts.astype(np.int64))
        return np.split(expand(self.symbols, self.under), stops[:-1])

    def symbols_of(self, k: int) -> np.ndarray:
        return self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]

    def ids(self, k: int, start: int = 0, count: int | None = None) -> np.ndarray:
        """Ids start .. start + count of document k; only symbols over that range are expanded."""
        s = self.symbols_of(k)
        if start == 0 and count is None:
            return expand(s, self.under)
        count = int(self.counts[k]) - start if count is None else count
        size = np.ones(len(s), np.int64)
        big = s >= self.first
        size[big] = self.sizes[s[big].astype(np.int64) - self.first]
        stop = np.cumsum(size)
        lo = int(np.searchsorted(stop, start, "right"))
        hi = int(np.searchsorted(stop, start + count)) + 1
        skip = start - (int(stop[lo - 1]) if lo else 0)
        return expand(s[lo:hi], self.under)[skip : skip + count]


def shards_of(content: bytes) -> Iterator[Shard]:
    """The shards of a file, one after another."""
    view, at = memoryview(content), 0
    while at < len(view):
        size = HEADER.unpack_from(view, at)[1]
        yield Shard(view[at : at + size])
        at += size


def write_ids(documents: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = 2, shard_ids: int = SHARD_IDS, file_shards: int = FILE_SHARDS) -> None:
    """Encode every text, append `end`, and write shards in ascending doc_id order under `path`.

    Files are in order of their names (see `place_of_file`); null ids come first; rows with equal ids
    stand by the hash of their text; null texts are empty.
    """
    order = ["doc_id", "row_hash"]
    rows = documents.select(F.col("doc_id").cast("long"), text_hash().alias("row_hash"), text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0
        words = encoder(vocabulary)
        first = words.tokenizer.get_vocab_size()

        def frame() -> pa.RecordBatch:
            # the sink adds the last byte
            return pa.RecordBatch.from_arrays([pa.array([write_shard(docs, ids, first, end)[:-1]], pa.binary())], names=["frame"])

        for batch in slices(batches, "text"):
            for doc, x in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text"), end), strict=True):
                if docs and held + len(x) > shard_ids:
                    yield frame()
                    docs, ids, held = [], [], 0
                docs.append(doc)
                ids.append(x)
                held += len(x)
        if docs:
            yield frame()

    frames = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("frame")).write.option("lineSep", "\0").option("maxRecordsPerFile", file_shards).text(path)


def place_of_file(name: str) -> tuple[int, int]:
    """A file's task and its number among the task's files."""
    task, number = re.search(r"part-(\d+)-.*-c(\d+)", name).groups()
    return int(task), int(number)


READ = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "at", "n_tokens", "ids_crc32")] + [T.StructField("file", T.StringType())])


def read_ids(documents_path: str, spark) -> DataFrame:
    """doc_id, place in its file, ids and their crc32, and the file, per document in the shards under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                at = 0
                for shard in shards_of(content.as_buffer()):
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.all_ids()]
                    ends = at + np.cumsum(shard.counts.astype(np.int64))
                    starts = ends - shard.counts
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.docs, pa.int64()),
                            pa.array(starts),
                            pa.array(shard.counts.astype(np.int64)),
                            pa.array(crcs, pa.int64()),
                            pa.array([name] * len(crcs)),
                        ],
                        names=READ.fieldNames(),
                    )
                    at = int(ends[-1])

    return spark.read.format("binaryFile").load(documents_path).select("path", "content").mapInArrow(run, READ)


def ids_report(documents: DataFrame, vocabulary: str = VOCABULARY, end: int = 2, shard_ids: int = SHARD_IDS, file_shards: int = FILE_SHARDS) -> DataFrame:
    """Write all ids, read the files back: doc_id, start (ids before it), n_tokens, ids_crc32.

    Null ids come first, rows with equal ids by the hash of their text; a null or
    empty text is an end id alone; an empty table gives no row.
    """
    spark = documents.sparkSession
    path = scratch(spark, "ids")
    write_ids(documents, path, vocabulary, end, shard_ids, file_shards)
    rows = stored(read_ids(path, spark), "ids-read")
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()  # a number a file
    before, n = [], 0
    for file, size in sorted(((r.file, r.n) for r in sizes), key=lambda x: place_of_file(x[0])):
        before.append((file, n))
        n += size
    base = spark.createDataFrame(before, "file string, base bigint")
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
