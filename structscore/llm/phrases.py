"""Phrase collocations: sketch bounds pick candidates, automata count them exactly.

1. Texts become blocks of one language, some 4 MB each: the block's vocabulary
   and its words by number, 0 between pieces.  Blocks are stored once.
2. Every block adds its words and phrases of two to five words into a sketch, a
   row of counters whose number grows with the corpus.  The counters are dealt
   out in shards by the hash's high bits; a block sends each shard the counters
   that it touches, and the shard answers, a bit each, whose sums reach the
   threshold.  Shards grow as the square root of the corpus, and so does their
   number, so that a block's rows stay few and hold many counters each.  A counter holds all phrases that fall on it, so its sum is an
   upper bound: nothing frequent is lost.
3. A block compiles its own phrases under counters that reach the threshold into
   an Aho-Corasick automaton and runs it over its words.  Words are written as
   codes of a fixed width that begin with a delimiter found nowhere else, so that
   matches begin and end at words, and a piece's end is a code of its own.
   Overlapping matches all count.  A task adds up its blocks' counts and deals
   them by phrase into buckets, whose number grows like the shards'; a bucket's
   sums are exact, and the threshold drops what only shared a counter.
4. Scores, dropped parts and each language's first phrases are joins, and a
   window whose rows are limited before the shuffle.

No table is sent to all tasks: what a block holds is bounded by its own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_bytes

MOST_WORDS = 5
LEAST = 100
FIRST = 2000

#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Words and phrases for each counter; bits that number a shard's counters, fewest and most (a byte each).
LOAD = 4
SHARD_BITS = (16, 28)

# What ends a piece, what stands between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if c in PIECE_ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

BLOCKS = "block bigint, lang string, n bigint, words binary, ids binary"
ENTRIES = "shard bigint, block bigint, cells binary, counts binary"
ANSWERS = "shard bigint, block bigint, bits binary"
TALLIES = "bucket bigint, lang string, phrases binary, counts binary"
COUNTS = "lang string, size int, phrase binary, a bigint"

#: Phrases that a task counts together before it sends them on.
HELD = 1_000_000


def _block(number: int, lang: str, texts: list[bytes]) -> tuple:
    """Texts of one language as words by number."""
    raw = b"\n".join([*texts, b""]).translate(_TABLE)
    tokens = pa.array(raw.replace(b".", b" . ").split(), pa.binary()).dictionary_encode()
    words = tokens.dictionary.to_pylist()
    place = np.arange(1, len(words) + 1, dtype=np.int32)
    if b"." in words:
        end = words.index(b".")
        place[end:] -= 1
        place[end] = 0
        words.pop(end)
    ids = place[tokens.indices.to_numpy()].astype("<i4")
    return number, lang, int((ids > 0).sum()), b" ".join(words), ids.tobytes()


def text_blocks(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents as blocks of a language; a text is never cut, so a block may be a long text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def full(limit: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            while sizes and (sum(sizes.values()) > limit or limit < 0):
                lang = max(sizes, key=sizes.__getitem__)
                row = _block(number, lang, held.pop(lang))
                sizes.pop(lang)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["block", "lang", "n", "words", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                    if sizes[lang] > block_bytes:
                        yield from full(sum(sizes.values()) - 1)
                    yield from full(4 * block_bytes)
        yield from full(-1)

    named = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_bytes().alias("text"))
    return named.mapInArrow(run, BLOCKS)


class Block:
    """A block's words, and the hashes of its words and phrases."""

    def __init__(self, lang: str, words: bytes, ids: bytes):
        self.words = words.split(b" ") if words else []
        self.ids = np.frombuffer(ids, "<i4")
        seed = xxhash.xxh64_intdigest(lang.encode()) & (1 << 63) - 1
        known = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.hashes = np.append(np.uint64(0), known)[self.ids]
        ends = np.append(np.flatnonzero(self.ids == 0), len(self.ids))
        #: words from each place to the end of its piece
        self.left = ends[np.searchsorted(ends, np.arange(len(self.ids)))] - np.arange(len(self.ids))

    def cells(self, n_cells: int) -> Iterator[np.ndarray]:
        """For phrases of one word, two, ...: the counters of those beginning at each place, junk where the piece is too short."""
        drop = np.uint64(64 - (n_cells.bit_length() - 1))
        h = self.hashes
        for size in range(1, MOST_WORDS + 1):
            if size > 1:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ self.hashes[size - 1 :]
            mixed = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            yield mixed >> drop if drop < 64 else np.zeros_like(mixed)
            h = mixed

    def touched(self, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The counters that the block adds to, ascending, and by how much."""
        found = [c[self.left[: len(c)] >= k + 1] for k, c in enumerate(self.cells(n_cells))]
        return np.unique(np.concatenate(found), return_counts=True)


def shard_bits(n_cells: int) -> int:
    """Bits of a counter's number in its shard: about half of all, and eight more."""
    low, high = SHARD_BITS
    return min(max((n_cells.bit_length() - 1) // 2 + 8, low), high)


def _by_shard(cells: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards that ascending counters fall into, and where each begins, with the end."""
    shards = (cells >> np.uint64(bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(cells) else np.zeros(0, np.int64)
    return shards[first], np.append(first, len(cells))


def _steps(cells: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """Counters as steps from the one before, in each shard from its first; in 16 bits where all fit."""
    low = (cells & np.uint64((1 << bits) - 1)).astype(np.int64)
    steps = np.diff(low, prepend=0)
    steps[bounds[:-1]] = low[bounds[:-1]]
    return steps.astype("<u2" if not len(steps) or steps.max() < 1 << 16 else "<u4")


def _binary(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of an array as binary values."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def sketched(blocks: DataFrame, n_cells: int, least: int = LEAST) -> DataFrame:
    """Which counters of each block reach `least`: a row per block and shard with one that does, a bit per counter touched."""
    kind = np.dtype("u1" if least < 256 else "<u4")  # counters stop at `least`: more need not be told apart
    width = shard_bits(n_cells)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells, counts = Block(row["lang"], row["words"], row["ids"]).touched(n_cells)
                shards, bounds = _by_shard(cells, width)
                many = np.minimum(counts, least).astype(kind)
                columns = [pa.array(shards), pa.array(np.full(len(shards), row["block"])), _binary(_steps(cells, bounds, width), bounds), _binary(many, bounds)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "cells", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int]] = []
        total = np.zeros(1 << width, kind)
        shard = None

        def places(cells: bytes, n: int) -> np.ndarray:
            return np.cumsum(np.frombuffer(cells, f"<u{len(cells) // n}"), dtype=np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            for block, cells, n in held:
                bits = total[places(cells, n)] >= least
                if bits.any():
                    row = (shard, block, np.packbits(bits).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "block", "bits"])

        for batch in batches:
            for now, block, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != shard:
                    yield from done()
                    held, shard = [], now
                    total[:] = 0
                many = np.frombuffer(counts, kind)
                at = places(cells, len(many))
                total[at] = np.minimum(total[at].astype(np.int64) + many, least)  # a row's counters differ
                held.append((block, cells, len(many)))
        yield from done()

    entries = blocks.select("block", "lang", "words", "ids").mapInArrow(send, ENTRIES)
    return entries.repartition("shard").sortWithinPartitions("shard").mapInArrow(answer, ANSWERS)


def _heavy(block: Block, n_cells: int, answers: list[dict]) -> np.ndarray:
    """The block's counters that reach the threshold, ascending."""
    cells, _ = block.touched(n_cells)
    shards, bounds = _by_shard(cells, shard_bits(n_cells))
    flags = np.zeros(len(cells), bool)
    at = {int(s): k for k, s in enumerate(shards)}
    for x in answers:
        k = at[x["shard"]]
        n = int(bounds[k + 1] - bounds[k])
        flags[bounds[k] : bounds[k + 1]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=n)
    return cells[flags]


def _codes(n_words: int, ids: np.ndarray) -> tuple[str, int]:
    """Words as codes, one after another, and a code's width: a blank and digits in base 32."""
    digits = 1
    while 32**digits <= n_words:
        digits += 1
    out = np.full((len(ids), digits + 1), ord(" "), np.uint8)
    for k in range(digits):
        out[:, k + 1] = (ids >> 5 * k & 31) + ord("A")
    out[ids == 0, 1:] = ord(".")
    return out.tobytes().decode("latin-1"), digits + 1


def counted(block: Block, heavy: np.ndarray, n_cells: int) -> Iterator[tuple[bytes, int]]:
    """(phrase, times) of the block's words and phrases whose counters reach the threshold."""
    import ahocorasick

    ids = block.ids
    text, width = _codes(len(block.words), ids)
    automaton = ahocorasick.Automaton()
    found: list[tuple[int, int]] = []
    reaches = rank = None
    for size, cells in enumerate(block.cells(n_cells), 1):
        n = len(cells)
        near = np.searchsorted(heavy, cells)
        near[near == len(heavy)] = 0
        ok = (block.left[:n] >= size) & (heavy[near] == cells if len(heavy) else False)
        if size == 1:
            rank = ids.astype(np.int64)
            times = np.bincount(ids[ok], minlength=len(block.words) + 1)
            for i in np.flatnonzero(times).tolist():
                yield block.words[i - 1], int(times[i])
        else:
            # both its parts, a word shorter, must reach it, too
            ok &= reaches[:n] & reaches[1 : n + 1]
            pair = np.where(ok, rank[:n] * (len(block.words) + 1) + ids[size - 1 :], -1)
            _, first, rank = np.unique(pair, return_index=True, return_inverse=True)
            for i in first[ok[first]].tolist():
                automaton.add_word(text[i * width : (i + size) * width], len(found))
                found.append((size, i))
        reaches = ok
    if found:
        automaton.make_automaton()
        times = np.bincount(np.fromiter((v for _, v in automaton.iter(text)), np.int64), minlength=len(found))
        for (size, i), a in zip(found, times.tolist(), strict=True):
            yield b" ".join(block.words[w - 1] for w in ids[i : i + size].tolist()), a


def _dealt(lang: str, phrases: list[bytes], counts: list[int], n_buckets: int) -> pa.RecordBatch:
    """Counts of a language's phrases, equal phrases added up, as a row for each bucket."""
    summed = pa.table({"p": pa.array(phrases, pa.binary()), "a": pa.array(counts, pa.int64())}).group_by("p").aggregate([("a", "sum")])
    names = summed.column("p").to_pylist()
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(p) % n_buckets for p in names), np.int64, len(names))
    order = np.argsort(bucket, kind="stable")
    bucket, many = bucket[order], summed.column("a_sum").to_numpy()[order].astype("<i8")
    bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    places = order.tolist()
    # a phrase holds no line end
    lists = [b"\n".join([names[i] for i in places[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    columns = [pa.array(bucket[bounds[:-1]]), pa.array([lang] * len(lists)), pa.array(lists, pa.binary()), _binary(many, bounds)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "phrases", "counts"])


def _tallies(n_cells: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[bytes], list[int]]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            while held:
                lang, (phrases, counts) = held.popitem()
                yield _dealt(lang, phrases, counts, n_buckets)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row["lang"], row["words"], row["ids"])
                phrases, counts = held.setdefault(row["lang"], ([], []))
                for phrase, a in counted(block, _heavy(block, n_cells, row["answers"]), n_cells):
                    phrases.append(phrase)
                    counts.append(a)
                if not phrases:
                    held.pop(row["lang"])
                if sum(len(p) for p, _ in held.values()) > HELD:
                    yield from flushed()
        yield from flushed()

    return run


def _added_up(least: int):
    """Rows sorted by bucket and language: sums of phrases that reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                total = pa.concat_tables(held).group_by("p").aggregate([("a", "sum")])
                total = total.filter(pc.greater_equal(total.column("a_sum"), least)).combine_chunks()
                phrases = total.column("p")
                size = pc.add(pc.count_substring(phrases, b" "), 1).cast(pa.int32())
                named = pa.table({"lang": pa.array([key[1]] * len(total), pa.string()), "size": size, "phrase": phrases, "a": total.column("a_sum")})
                yield from named.to_batches()

        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["bucket"], row["lang"]):
                    yield from done()
                    held, key = [], (row["bucket"], row["lang"])
                held.append(pa.table({"p": pa.array(row["phrases"].split(b"\n"), pa.binary()), "a": np.frombuffer(row["counts"], "<i8")}))
        yield from done()

    return run


def phrase_counts(documents: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a) of all words and phrases found `least` times or more, exactly, and (lang, n) words in all."""
    blocks = stored(text_blocks(documents, block_bytes), "blocks")
    words = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_cells = 1 << SHARD_BITS[0]
    while n_cells * LOAD < words * MOST_WORDS:
        n_cells *= 2
    answers = sketched(blocks, n_cells, least).groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))
    asked = blocks.join(answers, "block").select("lang", "words", "ids", "answers")
    n_buckets = 16 * (n_cells >> shard_bits(n_cells))
    dealt = asked.mapInArrow(_tallies(n_cells, n_buckets), TALLIES)
    sums = dealt.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_added_up(least), COUNTS)
    named = sums.withColumn("phrase", F.col("phrase").cast("string"))
    return stored(named, "counts"), stored(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "langs")


def scored(counts: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of every phrase, by its lowest cut; exact in 38 digits."""
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    words = F.split("phrase", " ")
    cuts = counts.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", F.array_join(F.slice(words, 1, F.col("k")), " ")).withColumn("tail", F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " "))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(langs, "lang")
    wide = "cast({} as decimal(19,0))".format
    score = F.expr(f"cast(1000 as decimal(4,0)) * {wide('a')} * {wide('n')} div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(documents: DataFrame, least: int = LEAST, first: int = FIRST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score.

    A null text has no words, a null language is `und` (and one with rows of that
    name); repeated rows count each, doc_id plays no part; an empty table has no
    rows.  Equal scores go by frequency, then by the phrase's bytes.

    A phrase inside a longer candidate that is as frequent goes.  The longer one
    then has a candidate one word longer than the phrase in it, just as frequent,
    so only phrases' longest parts are looked at.
    """
    counts, langs = phrase_counts(documents, least, block_bytes)
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " ")))
    covered = counts.where("size > 2").select("lang", inner.alias("phrase"), "a").distinct()
    left = scored(counts, langs).join(covered, ["lang", "phrase", "a"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
