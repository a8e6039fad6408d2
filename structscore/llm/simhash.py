"""SimHash near-dedup by an inverted index over byte positions, with count filtering.

A fingerprint has 64 bits in 8 byte positions.  Two that differ in at most 3
bits differ in at most 3 bytes, so they share at least 5 positional bytes.  The
index posts every distinct fingerprint under three positional bytes at once,
for 8 triples of positions: the triples inside {0..3} and inside {4..7}.  Of any
5 positions, 3 lie in one half, so every linked pair meets under a triple.  A
posting list with too many fingerprints is posted again under two of the five
other positions (a linked pair shares two of them as well), after which a list
has at most 2^24 fingerprints and is probed by flipping bits.

A list's fingerprints share its positions.  Each of the other positions has
sub-lists, a byte value each; the sub-lists that a pair is in together are
tallied, pairs that come to fewer than five shared positions in all go, and only
the rest are verified by their differing bits.  Only a spanning forest leaves the
task: connected fingerprints stay connected while a list of n fingerprints makes
n links at most.  Components grow by alternating star contractions over tables;
nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, stored, text_bytes, text_hash

TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]

#: Fingerprints of a posting list above which it is posted again, two bytes deeper.
LIST_LIMIT = 512

FINGERPRINTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("row_hash", T.LongType()), T.StructField("fp", T.LongType())]
)


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; a shorter text is one shingle."""
    w = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([digest(b" ".join(w), 42)], np.uint64)
    n = len(w) - words + 1
    return np.fromiter((digest(s, 42) for s in map(b" ".join, zip(*(w[i : i + n] for i in range(words)), strict=True))), np.uint64, n)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per array: a bit is set where over half of the hashes set it."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    n = sizes[full]
    ends = np.cumsum(n)
    # runs of at most 255 hashes, so that eight counters fit the bytes of one word
    owner = np.repeat(np.arange(len(full)), -(-n // 255))
    first = np.concatenate([np.arange(e - m, e, 255) for e, m in zip(ends, n, strict=True)])
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & ones, first)
        counts = np.zeros((len(full), 8), np.int64)
        np.add.at(counts, owner, lanes.view(np.uint8).reshape(-1, 8))
        over = 2 * counts > n[:, None]
        for lane in range(8):
            out[full] |= over[:, lane].astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, row_hash and the fingerprint as a signed long; null and empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            fp = majority_bits([shingle_hashes(t, words) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(fp.view(np.int64))], names=[f.name for f in FINGERPRINTS]
            )

    return documents.select(F.col("doc_id").cast("long"), text_hash().alias("row_hash"), text_bytes().alias("text")).mapInArrow(run, FINGERPRINTS)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _key(label: int, fp: Column, positions: tuple[int, ...]) -> Column:
    key = F.lit(label).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
    return key


def postings(distinct: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """(key, fp) such that each linked pair has a key in common; long lists go two bytes deeper."""
    fp = F.col("fp")
    lists = distinct.select(fp, F.explode(F.array(*[_key(i, fp, t) for i, t in enumerate(TRIPLES)])).alias("key"))
    long = stored(lists.groupBy("key").count().filter(F.col("count") > limit).select("key"), "long-lists")
    deeper = []
    for i, triple in enumerate(TRIPLES):
        rest = [p for p in range(8) if p not in triple]
        keys = [_key(8 + len(deeper) * 10 + j, fp, (*triple, *pair)) for j, pair in enumerate(combinations(rest, 2))]
        deeper.append(F.when(F.shiftright("key", 24) == i, F.array(*keys)))
    again = lists.join(long, "key", "left_semi").select(fp, F.explode(F.coalesce(*deeper)).alias("key"))
    return lists.join(long, "key", "left_anti").select("key", "fp").unionByName(again.select("key", "fp"))


#: Positions that a list's fingerprints share, by the label at the top of its key.
SHARED = dict(enumerate(TRIPLES)) | {
    8 + 10 * i + j: (*t, *pair) for i, t in enumerate(TRIPLES) for j, pair in enumerate(combinations([p for p in range(8) if p not in t], 2))
}


def _label(key: int) -> int:
    return key >> 40 if key >> 40 else key >> 24


def pairs_by_steps(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside runs of equal values, as places, by their distance."""
    end = np.searchsorted(group, group, "right")
    at, step = np.arange(len(group)), 1
    while len(at := at[at + step < end[at]]):
        yield at, at + step
        step += 1


def tally(lists: np.ndarray, fps: np.ndarray, shared: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that are in a list and in a sub-list of it together, and how many positional bytes they share in all.

    `lists` numbers the fingerprints' lists in ascending order.
    """
    found = []
    for p in range(8):
        if p not in shared:
            keys = lists.astype(np.uint64) << np.uint64(8) | fps >> np.uint64(8 * p) & np.uint64(255)
            order = np.argsort(keys, kind="stable").astype(np.uint64)
            found += [order[a] << np.uint64(32) | order[b] for a, b in pairs_by_steps(keys[order.astype(np.int64)])]
    pairs, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), times + len(shared)


def _near(lists: np.ndarray, fps: np.ndarray, shared: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list within `bits` differing bits: by the tally where it can rule pairs out, else all are verified."""
    if len(shared) >= 8 - bits:
        found = list(pairs_by_steps(lists))
    else:
        a, b, times = tally(lists, fps, shared)
        kept = times >= 8 - bits
        found = [(a[kept], b[kept])]
    ok = [np.bitwise_count(fps[a] ^ fps[b]) <= bits for a, b in found]
    return tuple(np.concatenate([x[k][o] for x, o in zip(found, ok, strict=True)] or [np.zeros(0, np.int64)]) for k in (0, 1))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _linked(keys: np.ndarray, fps: np.ndarray, bits: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest for each run of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    labels = np.array([_label(k) for k in keys[starts].tolist()])
    for label in np.unique(labels):
        own = np.flatnonzero(np.repeat((labels == label) & (sizes <= limit) & (sizes > 1), sizes))
        if len(own):
            a, b = _near(np.repeat(np.arange(len(starts)), sizes)[own], fps[own], SHARED[int(label)], bits)
            left.append(own[a])
            right.append(own[b])
    for s, n in zip(starts[sizes > limit], sizes[sizes > limit], strict=True):
        own = np.sort(fps[s : s + n])
        order = np.argsort(fps[s : s + n])
        varied = int(np.bitwise_or.reduce(own ^ own[0]))
        masks = [1 << b for b in range(64) if varied >> b & 1]
        for size in range(1, bits + 1):
            for chosen in combinations(masks, size):
                other = own ^ np.uint64(sum(chosen))
                at = np.minimum(np.searchsorted(own, other), n - 1)
                hit = np.flatnonzero((own[at] == other) & (own < other))
                left.append(s + order[hit])
                right.append(s + order[at[hit]])
    if not left:
        return fps[:0], fps[:0]
    root = _forest(len(keys), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(len(keys)))
    return fps[moved], fps[root[moved]]


def links(distinct: DataFrame, bits: int = 3, limit: int = LIST_LIMIT) -> DataFrame:
    """(u, v): links whose components are those of all pairs within `bits` differing bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(k) > 1:
                u, v = _linked(k, f, bits, limit)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last list may go on
            yield from done(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        yield from done(keys, fps)

    return postings(distinct, limit).repartition("key").sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root): the smallest node of each node's component, by large and small stars.

    Each round is a checkpointed table of distinct links.  It ends when a round
    changes nothing.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        edges = small.checkpoint()
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select("u", F.col("v").alias("root"))


def near_duplicates(documents: DataFrame, bits: int = 3, words: int = 3, limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, row_hash, fp, root and component_id (smallest doc_id reachable over links), one row per row.

    The root is the component's smallest fingerprint.  Texts without words have
    fingerprint zero and are linked like others.  Equal rows stay.  A null doc_id
    never names a component that has another id; without one, component_id is null.
    """
    rows = stored(fingerprints(documents, words), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(nodes.select("fp"), bits, limit))
    named = nodes.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = stored(named, "roots")
    lowest = names.groupBy("root").agg(F.min("low").alias("component_id"))
    known = names.join(lowest, "root").select(F.col("fp").alias("f"), "root", "component_id")
    return rows.join(known, F.col("fp") == F.col("f")).select("doc_id", "row_hash", "fp", "root", "component_id")


def simhash_report(documents: DataFrame) -> DataFrame:
    """doc_id, the fingerprint in hex and component_id, a row per row; texts without words and null texts have fingerprint zero."""
    found = near_duplicates(documents.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, of equal ids the smallest text hash.

    Columns are those of `documents`.  Of wholly repeated rows one stays.  The
    rows move once: they meet the chosen ids and lose repeats under the same key.
    """
    found = near_duplicates(documents)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("k"))
    mark = fresh(documents, "_row")
    number, name = mark + "_id", mark + "_hash"

    def key(doc_id: Column, row_hash: Column) -> list[Column]:
        return [F.coalesce(doc_id, F.lit(0)).alias(number), F.xxhash64(row_hash, doc_id.isNull()).alias(name)]

    chosen = first.select(*key(F.col("k.doc_id"), F.col("k.row_hash")))
    rows = documents.select("*", *key(F.col("doc_id").cast("long"), text_hash()))
    return rows.join(chosen, [number, name], "left_semi").dropDuplicates([number, name]).select(*documents.columns)
