"""Benchmark decontamination with a generalised suffix automaton of the test items.

Test items are small beside the corpus, so the automaton is built on the driver
and sent to every task; its size is checked first.  More items than fit in one
automaton are taken in blocks, each a pass of the whole corpus, whose hits are
joined per document.  The corpus itself is only streamed: a document's hits
depend on nothing but the document and the automaton, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, stored, text_bytes, text_hash

#: ASCII that is no letter or digit separates words; A-Z become a-z; bytes of
#: other characters belong to words.
WORD_BYTES = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32
    for c in (*range(0x80), *range(0x80, 0x100))
)

#: Words of test items in one automaton (about 0.5 KB a word in Python).
MAX_AUTOMATON_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window.

    `next`, `link` and `length` are the usual arrays.  A window is `window`
    consecutive words of an item, or a whole item that is shorter.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[bytes, int] = {}
        items = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: state -> items, for states that hold a window of full length
        self.full: dict[int, set[str]] = {}
        #: state -> (length, items), for states where a short item ends
        self.short: dict[int, tuple[int, set[str]]] = {}
        for name, words in items:
            state, n = 0, 0
            for w in words:
                state, n = self.step(state, n, w)
                if n >= window:
                    self.full.setdefault(self.window_state(state), set()).add(name)
            if len(words) < window:
                self.short.setdefault(state, (len(words), set()))[1].add(name)
        #: nearest state up the links, itself included, where a short item ends
        self.near = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near[state] = state if state in self.short else self.near[self.link[state]]
        self.shortest = min([window, *(n for n, _ in self.short.values())])

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            old = self.next[last][w]
            return old if self.length[old] == self.length[last] + 1 else self._clone(last, w, old)
        new = self._add({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][w]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._clone(at, w, old)
        return new

    def _add(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, at: int, w: int, old: int) -> int:
        twin = self._add(dict(self.next[old]), self.length[at] + 1, self.link[old])
        self.link[old] = twin
        while at >= 0 and self.next[at].get(w) == old:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """Longest suffix of what was read that is in an item, after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], n + 1
        return 0, 0

    def window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a window's occurrence, and the items of those windows."""
        hit = np.zeros(len(words) + 1, np.int64)
        items: set[str] = set()
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        for start, end in known.reshape(-1, 2):
            if end - start < self.shortest:
                continue  # no window fits between two words that no item has
            state = n = 0
            for i, w in enumerate(ids[start:end].tolist(), start):
                state, n = self.step(state, n, w)
                if n >= self.window:
                    at = self.window_state(state)
                    hit[i + 1 - self.window] += 1
                    hit[i + 1] -= 1
                    items |= self.full[at]
                if n >= self.shortest:
                    at = self.near[state] if n >= self.length[state] else self.near[self.link[state]]
                    if state in self.short and n >= self.short[state][0]:
                        at = state
                    while at > 0:
                        size, found = self.short[at]
                        hit[i + 1 - size] += 1
                        hit[i + 1] -= 1
                        items |= found
                        at = self.near[self.link[at]]
        return np.cumsum(hit[:-1]) > 0, items


def _blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[ItemAutomaton]:
    """Automata of at most `most` words each; a longer item is cut into parts that share all but one word of a window."""
    held: list[tuple[str, list[bytes]]] = []
    n = 0
    most = max(most, 2 * window)
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), text_bytes().alias("t")).toLocalIterator():
        whole = words_of(bytes(row.t))
        # every window lies in a part, and no part is shorter than a window unless the item is
        for at in range(0, max(1, len(whole) - window + 1), most - window + 1):
            words = whole[at : at + most]
            if held and n + len(words) > most:
                yield ItemAutomaton(held, window)
                held, n = [], 0
            held.append(("" if row.i is None else row.i, words))
            n += len(words)
    yield ItemAutomaton(held, window)


HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row_hash", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("hit", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def match_items(
    documents: DataFrame, benchmark: DataFrame, window: int = 13, max_automaton_words: int = MAX_AUTOMATON_WORDS
) -> DataFrame:
    """Per document: words, a bitmap of the words hit (numpy packbits) and the items found.

    Null or empty texts have no words.  Equal rows give equal rows.  Items with
    equal ids count as one item; an item without words has no window; an empty
    benchmark hits nothing.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), text_hash().alias("row_hash"), text_bytes().alias("text"))
    parts = []
    for automaton in _blocks(benchmark, window, max_automaton_words):
        sent = spark.sparkContext.broadcast(automaton)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = sent.value
            for batch in slices(batches, "text"):
                counts, hits, items = [], [], []
                for text in batch.column("text"):
                    words = words_of(text.as_py())
                    hit, names = found.scan(words)
                    counts.append(len(words))
                    hits.append(np.packbits(hit).tobytes() if names else b"")
                    items.append(sorted(names))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("row_hash"),
                        pa.array(counts, pa.int64()),
                        pa.array(hits, pa.binary()),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=[f.name for f in HITS],
                )

        parts.append(docs.mapInArrow(scan, HITS))
    if len(parts) == 1:
        return parts[0]
    # the blocks' hits of a document meet; documents without hits keep one row of the first block
    first, rest = parts[0], [p.filter(F.size("items") > 0) for p in parts[1:]]
    every = first
    for p in rest:
        every = every.unionByName(p)
    rows = docs.groupBy("doc_id", "row_hash").count().withColumnRenamed("count", "copies")
    merged = (
        stored(every, "decontaminate")
        .groupBy("doc_id", "row_hash")
        .agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("items").alias("sets"))
    )

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for n, masks in zip(batch.column("n_words").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                bits = np.zeros((n + 7) // 8, np.uint8)
                for m in masks:
                    if m:
                        bits |= np.frombuffer(m, np.uint8)
                hits.append(bits.tobytes() if any(masks) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), batch.column("n_words"), pa.array(hits, pa.binary()), batch.column("items")],
                names=[f.name for f in HITS],
            )

    merged = merged.join(
        rows.withColumnsRenamed({"doc_id": "d", "row_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("h"))
    )
    return (
        merged.withColumn("items", F.array_sort(F.array_distinct(F.flatten("sets"))))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc_id", "row_hash", "n_words", "hits", "items")
        .mapInArrow(union, HITS)
    )


def _bits_set(mask: bytes) -> int:
    return int(np.unpackbits(np.frombuffer(mask, np.uint8)).sum())


def contamination_report(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Counts per document; contaminated: a word hit, and at least 1 in `share` words.

    A null or empty text has no words and isn't contaminated; rows that repeat
    are reported each; an empty table has no rows, an empty benchmark hits
    nothing.  Other columns play no part, whatever their names.
    """
    matched = match_items(documents, benchmark, window)
    out = T.StructType(
        [T.StructField("doc_id", T.LongType())]
        + [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")]
        + [T.StructField("items_sha256", T.StringType())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    pa.array([_bits_set(m) for m in batch.column("hit").to_pylist()], pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                ],
                names=[f.name for f in out],
            )

    return matched.mapInArrow(count, out).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    )


def remove_spans(
    documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, max_automaton_words: int = MAX_AUTOMATON_WORDS
) -> DataFrame:
    """`documents` without what the test items share with them.

    A document whose coverage reaches the limit goes.  From others the hit words
    and the separators between two hit words go; the rest stays byte for byte.
    Columns are those of `documents`; a null text stays null.  Of several
    automata a task holds one: the words hit so far are written between them.
    """
    spark = documents.sparkSession
    schema = documents.schema
    mark = fresh(documents, "_hit")
    marked = T.StructType([*schema.fields, T.StructField(mark, T.BinaryType())])
    at = schema.fieldNames().index("text")

    def hits(automaton: ItemAutomaton, text: str | None, before: bytes | None) -> np.ndarray:
        """Which words are hit, by this automaton or those before it."""
        words = words_of((text or "").encode())
        hit = automaton.scan(words)[0]
        return hit | np.unpackbits(np.frombuffer(before, np.uint8))[: len(words)].astype(bool) if before else hit

    def marking(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                found = zip(batch.column("text").to_pylist(), batch.column(mark).to_pylist(), strict=True)
                bits = pa.array([np.packbits(hits(sent.value, t, m)).tobytes() for t, m in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bits], schema=batch.schema)

        return run

    def cutting(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                texts, keep = [], []
                for text, before in zip(batch.column("text").to_pylist(), batch.column(mark).to_pylist(), strict=True):
                    hit = hits(sent.value, text, before)
                    n = int(hit.sum())
                    keep.append(not n or share * n < len(hit))
                    texts.append(_without(text.encode(), hit) if n and keep[-1] else text)
                arrays = list(batch.columns[:-1])
                arrays[at] = pa.array(texts, arrays[at].type)
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames()).filter(pa.array(keep, pa.bool_()))

        return run

    blocks = _blocks(benchmark, window, max_automaton_words)
    now = next(blocks)
    rows = documents.withColumn(mark, F.lit(None).cast("binary"))
    for following in blocks:
        rows = stored(rows.mapInArrow(marking(spark.sparkContext.broadcast(now)), marked), "hits")
        now = following
    return rows.mapInArrow(cutting(spark.sparkContext.broadcast(now)), schema)


def _without(raw: bytes, hit: np.ndarray) -> str:
    flat = np.frombuffer(raw.translate(WORD_BYTES), np.uint8)
    inside = np.isin(flat, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8), invert=True)
    edge = np.diff(np.concatenate(([0], inside, [0])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    drop = np.zeros(len(raw) + 1, np.int32)
    runs = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8))).reshape(-1, 2)
    for first, last in runs:
        drop[starts[first]] += 1
        drop[ends[last - 1]] -= 1
    kept = np.frombuffer(raw, np.uint8)[np.cumsum(drop[:-1]) == 0]
    return kept.tobytes().decode("utf-8", "replace")
