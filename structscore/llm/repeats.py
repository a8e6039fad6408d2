"""Removal of long repeated byte strings by prefix-free parsing.

Text is parsed at triggers of a rolling hash: of every `SPAN` neighbouring
16-byte hashes the smallest is a trigger, so that the trigger of a 200-byte
string depends on that string alone and equal strings are parsed alike wherever
they stand.  The starts whose strings share a trigger form a run; the bytes that
these strings cover are a phrase of the dictionary, the runs in order are the
parse.  Phrases overlap so far that no string leaves its phrase: corpus order,
as far as 200 bytes reach, is the order of the dictionary's suffixes with the
runs of a phrase side by side.

1. The parse is ordered by phrase names (two 64-bit hashes, of the core that all
   strings of a run hold and of the whole phrase).  All strings of a phrase with
   several runs repeat.  Inside a slice of input they settle each other and send
   one row on, so the copies of a hot passage are combined before the shuffle.
2. A core with several phrases: a shard takes all phrases of its cores, since
   equal strings have one core.  It orders what they hold before the trigger
   (suffixes of the dictionary) and from the trigger on (what follows in the
   parse) by bytes, with the lengths that neighbours have in common, and combines
   both into the order of all strings; equal neighbours repeat.  Phrases alone
   with their core have nothing to be compared with and are not fetched.  The
   strings of a core with very many phrases are put in order by a range sort of
   their bytes instead.  Rows that repeat (doc_id and text) are fetched once.

Intervals meet their documents at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, text_bytes, text_hash

GRAM, SPAN = 16, 140

#: Phrases of one core above which their suffixes are ordered by a shuffle.
HOT_CORE = 20_000

#: A run's place: its first start, the trigger's distance, starts less one.
FIELDS = [("g", T.LongType()), ("e", T.LongType()), ("doc_id", T.LongType()), ("row_hash", T.LongType()), ("run", T.LongType()), ("state", T.ByteType())]
RUNS = T.StructType([T.StructField(n, t) for n, t in FIELDS])
OPEN, SETTLED, SENT = 0, 1, 2  # to be decided; repeats, but sent on for others; repeats


def packed(start: np.ndarray, lead: np.ndarray, more: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 20 | lead.astype(np.int64) << 10 | more.astype(np.int64)


def unpacked(run: int) -> tuple[int, int, int]:
    return run >> 20, run >> 10 & 1023, run & 1023


def _gram_order(text: np.ndarray) -> np.ndarray:
    """A sort key per position: hash of its 16 bytes, then the position."""
    n = len(text) - GRAM + 1
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(n, dtype=np.uint64)
    return h


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least key of every `span` neighbours, from blockwise running minima."""
    n = len(keys) - span + 1
    full = -(-len(keys) // span) * span
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def parse(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all texts: text number, first start in it, trigger's distance, starts - 1, and the joined bytes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if not len(lengths) or lengths.max() < size:
        return none, none, none, none, flat
    trigger = (_least(_gram_order(flat), SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    long = np.flatnonzero(lengths >= size)
    counts = lengths[long] - size + 1
    shift = np.repeat(starts[long] - (np.cumsum(counts) - counts), counts)
    at = np.arange(len(shift)) + shift  # all starts of strings, in joined bytes
    owner = np.repeat(long, counts)
    t = trigger[at]
    first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (owner[1:] != owner[:-1]))))
    more = np.diff(np.append(first, len(at))) - 1
    return owner[first], at[first] - starts[owner[first]], t[first] - at[first], more, flat


def _runs(size: int):
    core = size - SPAN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            owner, start, lead, more, flat = parse(texts, size)
            if not len(owner):
                continue
            view = flat.tobytes()
            base = np.cumsum([0, *map(len, texts)])[owner] + start
            digest = xxhash.xxh3_64_intdigest
            n = len(owner)
            g = np.fromiter((digest(view[t : t + core]) for t in (base + lead).tolist()), np.uint64, n).view(np.int64)
            e = np.fromiter((digest(view[a:b], 1) for a, b in zip(base.tolist(), (base + more + size).tolist(), strict=True)), np.uint64, n).view(np.int64)
            order = np.lexsort((e, g))
            fresh = np.concatenate(([True], (g[order][1:] != g[order][:-1]) | (e[order][1:] != e[order][:-1])))
            copies = np.diff(np.append(np.flatnonzero(fresh), n))
            state = np.full(n, SENT, np.int8)
            state[order[fresh]] = np.where(copies > 1, SETTLED, OPEN)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g),
                    pa.array(e),
                    batch.column("doc_id").take(pa.array(owner)),
                    batch.column("row_hash").take(pa.array(owner)),
                    pa.array(packed(start, lead, more)),
                    pa.array(state),
                ],
                names=RUNS.fieldNames(),
            )

    return run


SETTLES = "kind tinyint, g bigint, e bigint, doc_id bigint, row_hash bigint, run bigint, state tinyint"
SETTLES_NAMES = ["kind", *RUNS.fieldNames()]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core and phrase: which phrases repeat, and which cores have several phrases.

    kind 0: a run that repeats.  kind 1: one run of each phrase of a core with
    several phrases, its state telling whether the phrase repeats.  kind 2: the
    number of phrases of such a core, as run.  Of a phrase that goes on in the
    next batch one row is carried over, however many there were.
    """
    carried: pa.RecordBatch | None = None
    prior = 0  # phrases of the carried row's core that are done

    def made(kind: int, rows: pa.RecordBatch, state: np.ndarray, run: np.ndarray | None = None) -> pa.RecordBatch:
        columns = [pa.array(np.full(rows.num_rows, kind, np.int8)), *rows.columns[:-1], pa.array(state.astype(np.int8))]
        if run is not None:
            columns[SETTLES_NAMES.index("run")] = pa.array(run)
        return pa.RecordBatch.from_arrays(columns, names=SETTLES_NAMES)

    def settled(rows: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal carried, prior
        g, e, state = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("g", "e", "state"))
        first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (e[1:] != e[:-1]))))
        times = np.diff(np.append(first, len(g)))
        again = np.maximum.reduceat(state == SETTLED, first) | (times > 1)
        found = np.flatnonzero((state == OPEN) & np.repeat(times > 1, times))
        if len(found):
            yield made(0, rows.take(pa.array(found)), np.full(len(found), SETTLED))
        core = np.flatnonzero(np.concatenate(([True], g[first][1:] != g[first][:-1])))
        phrases = np.diff(np.append(core, len(first)))
        known = phrases.copy()
        known[0] += prior
        several = np.repeat(known > 1, phrases)
        if not last:
            several[-1] = False  # it may go on
        shown = np.flatnonzero(several)
        if len(shown):
            yield made(1, rows.take(pa.array(first[shown])), np.where(again[shown], SETTLED, OPEN))
        done = np.flatnonzero(known > 1) if last else np.flatnonzero(known[:-1] > 1)
        if len(done):
            yield made(2, rows.take(pa.array(first[core[done]])), np.zeros(len(done)), known[done].astype(np.int64))
        if not last:
            keep = rows.slice(int(first[-1]), 1)
            if times[-1] > 1:
                keep = keep.set_column(keep.num_columns - 1, "state", pa.array([SETTLED], pa.int8()))
            carried, prior = keep, int(known[-1]) - 1

    for batch in batches:
        if batch.num_rows:
            rows = pa.RecordBatch.from_arrays(batch.columns, names=RUNS.fieldNames())
            if carried is not None:
                if carried.column("g")[0] != rows.column("g")[0]:
                    # the phrase and its core end here
                    yield from settled(carried, True)
                    prior = 0
                else:
                    rows = pa.concat_batches([carried, rows])
            yield from settled(rows, False)
    if carried is not None:
        yield from settled(carried, True)


def _fetch(size: int):
    """The bytes of each phrase that a document was asked for; a row that repeats gives them once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # of rows that repeat one is enough
        for batch in slices(batches, "text", 2 << 20):
            rows: list[tuple] = []
            for text, doc, mark, asked in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "row_hash", "asked")), strict=True):
                if (doc, mark) in seen:
                    continue
                seen.add((doc, mark))
                for x in asked:
                    start, _, more = unpacked(x["run"])
                    rows.append((x["g"], doc, mark, x["run"], x["state"], text[start : start + more + size]))
                if len(rows) > 8192:
                    yield _phrase_batch(rows)
                    rows = []
            if rows:
                yield _phrase_batch(rows)

    return run


PHRASES = "g bigint, doc_id bigint, row_hash bigint, run bigint, state tinyint, bytes binary"


def _phrase_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["g", "doc_id", "row_hash", "run", "state", "bytes"]
    )


INTERVALS = "doc_id bigint, row_hash bigint, start bigint, stop bigint"


def in_order(core: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of `parts` by core and bytes, and the bytes that each place has in common with the one before (-1: another core)."""
    table = np.zeros((len(parts), 8 + width), np.uint8)
    table[:, :8] = (core.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    row = np.repeat(np.arange(len(parts)), lengths)
    table[row, 8 + np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.frombuffer(b"".join(parts), np.uint8)
    order = np.argsort(table.view(f"S{8 + width}").ravel(), kind="stable")
    ordered = table[order]
    unlike = ordered[1:] != ordered[:-1]
    common = np.where(unlike.any(1), unlike.argmax(1), 8 + width) - 8
    return order, np.concatenate(([-1], np.maximum(common, -1)))


def combined(core: np.ndarray, phrases: list[bytes], lead: np.ndarray, more: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings of these phrases as (phrase, start in it, rank before the trigger, rank from the trigger on).

    A string is `back` bytes before its trigger and size - back from it on.  The
    dictionary's suffixes up to the trigger are ordered backwards from there,
    what follows in the parse forwards; both orders give, for every length, the
    ranks of all phrases by as many bytes.  Strings of one core with equal back
    are in corpus order by the two ranks, and equal where both are.
    """
    widest = int(lead.max())
    counts = more + 1
    whose = np.repeat(np.arange(len(phrases)), counts)
    inside = np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)
    back = lead[whose] - inside
    ranks = []
    for parts, width, length in (
        ([p[:n][::-1] for p, n in zip(phrases, lead.tolist(), strict=True)], widest, back),
        ([p[n:] for p, n in zip(phrases, lead.tolist(), strict=True)], size, size - back),
    ):
        order, common = in_order(core, parts, width)
        lowest = int(length.min())
        lengths = np.arange(lowest, int(length.max()) + 1)
        by_length = np.empty((len(lengths), len(parts)), np.int32)
        by_length[:, order] = np.cumsum(common < lengths[:, None], 1, dtype=np.int32)
        ranks.append(by_length[length - lowest, whose].astype(np.int64))
    return whose, inside, *ranks


def equal_to_another(back: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which strings have an equal neighbour in corpus order."""
    key = back.astype(np.uint64) << np.uint64(48) | left.astype(np.uint64) << np.uint64(24) | right.astype(np.uint64)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twin = np.zeros(len(key), bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    return twin


def _distinct(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows sorted by core and place without those that several tasks fetched."""
    names = ["g", "doc_id", "row_hash", "run"]
    table = np.stack([pc.fill_null(rows.column(c), -1).to_numpy(zero_copy_only=False) for c in names] + [rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)])
    fresh = np.append(True, (table[:, 1:] != table[:, :-1]).any(0))[: rows.num_rows]
    return rows if fresh.all() else rows.filter(pa.array(fresh))


#: Bytes of phrases that are put in order together, about.
SHARD_BYTES = 2 << 20


def _order_suffixes(size: int, shard: int = SHARD_BYTES):
    """Rows sorted by core: the intervals of open phrases whose strings have an equal one in the shard's order."""

    def matched(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole cores."""
        held = _distinct(pa.concat_batches(rows))
        if held.num_rows < 2:
            return
        place = held.column("run").to_numpy()
        lead, more = place >> 10 & 1023, place & 1023
        whose, inside, left, right = combined(held.column("g").to_numpy(), held.column("bytes").to_pylist(), lead, more, size)
        twin = equal_to_another(lead[whose] - inside, left, right)
        twin &= (held.column("state").to_numpy() == OPEN)[whose]
        fresh = np.flatnonzero(twin & ~np.concatenate(([False], twin[:-1] & (whose[1:] == whose[:-1]))))
        ends = np.flatnonzero(twin & ~np.concatenate((twin[1:] & (whose[1:] == whose[:-1]), [False])))
        if len(fresh):
            own = pa.array(whose[fresh])
            start = (place >> 20)[whose[fresh]]
            columns = [held.column("doc_id").take(own), held.column("row_hash").take(own), pa.array(start + inside[fresh]), pa.array(start + inside[ends] + size)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_hash", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in slices(batches, "bytes", shard):
            n += pc.sum(pc.binary_length(batch.column("bytes"))).as_py()
            held.append(batch)
            if n > shard:
                rows = pa.concat_batches(held)
                g = rows.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last core may go on
                if cut:
                    yield from matched([rows.slice(0, cut)])
                held = [rows.slice(cut)]
                n = pc.sum(pc.binary_length(held[0].column("bytes"))).as_py()
        if held:
            yield from matched(held)

    return run


SUFFIXES = "g bigint, back bigint, suffix binary, doc_id bigint, row_hash bigint, start bigint"
SUFFIX_NAMES = ["g", "back", "suffix", "doc_id", "row_hash", "start"]


def _suffixes(size: int):
    """Every string of a phrase as a row, with its core and how far before the trigger it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 14):
            rows: list[tuple] = []
            for g, doc, mark, place, phrase in zip(*(batch.column(c).to_pylist() for c in ("g", "doc_id", "row_hash", "run", "bytes")), strict=True):
                start, lead, _ = unpacked(place)
                rows += [(g, lead - i, phrase[i : i + size], doc, mark, start + i) for i in range(len(phrase) - size + 1)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=SUFFIX_NAMES)

    return run


def _equal_neighbours(size: int):
    """Strings in corpus order: the intervals of those that equal the one before or behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before this batch, not told yet whether it repeats
        told = False  # it did, by its own neighbour before

        def emitted(rows: pa.RecordBatch, twin: np.ndarray) -> Iterator[pa.RecordBatch]:
            some = rows.filter(pa.array(twin))
            if some.num_rows:
                start = some.column("start")
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("row_hash"), start, pc.add(start, size)], names=["doc_id", "row_hash", "start", "stop"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.concat_batches([last, batch])
            same = np.ones(rows.num_rows - 1, bool)
            for c in ("g", "back", "suffix"):
                same &= pc.equal(rows.column(c)[1:], rows.column(c)[:-1]).to_numpy(zero_copy_only=False)
            twin = np.append(told, same) | np.append(same, False)
            yield from emitted(rows.slice(0, rows.num_rows - 1), twin[:-1])
            last, told = rows.slice(rows.num_rows - 1), bool(twin[-1])
        if last is not None and told:
            yield from emitted(last, np.array([True]))

    return run


def _hot_suffixes(phrases: DataFrame, size: int) -> DataFrame:
    """Intervals for phrases of hot cores: their strings are range-sorted by core, distance to the trigger and bytes."""
    once = phrases.dropDuplicates(["g", "doc_id", "row_hash", "run"])
    order = ["g", "back", "suffix"]
    suffixes = stored(once.mapInArrow(_suffixes(size), SUFFIXES), "hot-suffixes")
    return suffixes.repartitionByRange(*order).sortWithinPartitions(*order).select(SUFFIX_NAMES).mapInArrow(_equal_neighbours(size), INTERVALS)


def repeated_intervals(documents: DataFrame, size: int = 200, hot: int = HOT_CORE) -> DataFrame:
    """(doc_id, row_hash, start, stop): byte intervals covered by repeated strings; they may overlap."""
    if not SPAN + GRAM - 1 <= size < 1024:
        raise ValueError(f"strings of {SPAN + GRAM - 1} to 1023 bytes can be looked for")
    docs = documents.select(F.col("doc_id").cast("long"), text_hash().alias("row_hash"), text_bytes().alias("text")).filter(F.length("text") >= size)
    runs = stored(docs.mapInArrow(_runs(size), RUNS), "runs")
    settled = stored(
        runs.filter(F.col("state") != SENT).repartition("g").sortWithinPartitions("g", "e").mapInArrow(_settle, SETTLES), "settled"
    )
    crowded = settled.filter((F.col("kind") == 2) & (F.col("run") > hot)).select("g")
    asked = settled.filter("kind = 1").groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("g", "run", "state")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "d", "row_hash": "h"})
    unique = docs.join(asked, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["row_hash"] == F.col("h")))
    phrases = stored(unique.select("text", "doc_id", "row_hash", "asked").mapInArrow(_fetch(size), PHRASES), "phrases")
    few = phrases.join(crowded, "g", "left_anti").select(*phrases.columns).repartition("g").sortWithinPartitions("g", "doc_id", "row_hash", "run").mapInArrow(_order_suffixes(size), INTERVALS)
    many = _hot_suffixes(phrases.join(crowded, "g", "left_semi").select(*phrases.columns), size)
    start, more = F.shiftright("run", 20), F.col("run").bitwiseAND(1023)
    whole = runs.filter(F.col("state") != OPEN).select("doc_id", "row_hash", "run").unionByName(settled.filter("kind = 0").select("doc_id", "row_hash", "run"))
    whole = whole.select("doc_id", "row_hash", start.alias("start"), (start + more + size).alias("stop"))
    return whole.unionByName(few).unionByName(many)


REPORT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
)


def cut(text: bytes, intervals: list[dict] | None) -> tuple[bytes, int]:
    """The text without the intervals, and how many maximal runs went."""
    if not intervals:
        return text, 0
    depth = np.zeros(len(text) + 1, np.int64)
    np.add.at(depth, [x["start"] for x in intervals], 1)
    np.add.at(depth, [x["stop"] for x in intervals], -1)
    gone = np.cumsum(depth[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone)).astype(np.int8)) == 1))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), spans


def with_intervals(documents: DataFrame, intervals: DataFrame, mark: str = "gone") -> DataFrame:
    """`documents` with the list of their intervals as column `mark` (null where there is none); copies of a row share one list."""
    lists = intervals.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("start", "stop")).alias(mark))
    lists = lists.withColumnsRenamed({"doc_id": mark + "_id", "row_hash": mark + "_hash"})
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(mark + "_id")) & (text_hash() == F.col(mark + "_hash"))
    return documents.join(lists, on, "left").drop(mark + "_id", mark + "_hash")


def repeat_report(documents: DataFrame, size: int = 200, hot: int = HOT_CORE) -> DataFrame:
    """Per row: bytes, bytes removed, removed runs, digest of the rest.

    A null text is empty; texts shorter than `size` keep all; repeated rows
    repeat each other's strings and lose them all.
    """
    docs = documents.select("doc_id", "text")
    both = with_intervals(docs, repeated_intervals(docs, size, hot)).select(F.col("doc_id").cast("long"), text_bytes().alias("text"), "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            rest = [cut(t, g) for t, g in zip(texts, batch.column("gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(t) - len(k) for t, (k, _) in zip(texts, rest, strict=True)], pa.int64()),
                    pa.array([n for _, n in rest], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k, _ in rest]),
                ],
                names=REPORT.fieldNames(),
            )

    return both.mapInArrow(run, REPORT)
