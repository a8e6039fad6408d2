"""Hierarchical Pitman-Yor language model of word pairs, and scores under it.

Restaurants: one per context word, all sharing the root as parent, whose base
is uniform over the training vocabulary and one unknown word.  In a restaurant
the customers of dish w after context v sit at tables; each table is a customer
of the root, where dish w sits at tables again.  Seats are sampled by Gibbs (see
`seating`): customers leave and are seated given all others.  After sweeps that
only settle, each further one is a sample: the predictive probabilities of the
samples are averaged and score the texts.  theta and the discount of both
levels are drawn in every sweep.

Work is dealt as compact arrays.  A block of texts asks about each of its word
pairs once, however many texts hold it: pairs go to shards by context, so that a
restaurant is in one place; frequent contexts go by dish as well.  Shards sweep
side by side.  Between sweeps they tell the owners of words how many tables each
dish has, the owners seat these customers at the root, and answer with what the
root holds; the totals of frequent contexts go the same way.  At the end a shard
answers the blocks with one probability a pair, and the blocks, read once more,
sum them over their texts.  Every array is bounded by the shard's or block's
size, and their number grows with the input; no row is sent without a pair, so
there are never more rows than pairs.  Frequent contexts are those words whose
exact count is above a limit; there are at most tokens / limit of them, a checked
number.  These and a row of sums an exchange are all that reaches the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, slices, stored, text_bytes
from .seating import Seats, Weights, discount_sum, draw_parameters, sweep, theta_sums

#: The end of a text, as a word's hash; also the context of a first word.
END = np.uint64(0)

BLOCK_TOKENS, SHARD_TOKENS, OWNER_SHARDS = 3 << 19, 3 << 20, 8

#: A block's texts of so many bytes, one at least, are few words: very long ones.
BLOCK_BYTES = 1 << 26

#: Contexts with more tokens are spread by dish, for a share of a shard each; most of these that tasks are told of.
CONTEXT_TOKENS, MOST_FREQUENT = SHARD_TOKENS // 4, 1 << 23

(PAIRS, TEXTS, STATE, FULL, ANSWER, ASK, INDEX, REST, ROOT, REPLY, TABLES, LAST, CONSTANT, NUMBERS) = range(14)

ROWS = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("part", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)

Row = tuple[int, int, int, bytes]


# -- arrays as bytes -------------------------------------------------------


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays with their bytes sorted into planes, compressed."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""
        packed = zstandard.ZstdCompressor(level=1).compress(planes)
        head += [ord(a.dtype.kind), a.itemsize, len(a), len(packed)]
        body.append(packed)
    return np.array([len(arrays), *head], "<i8").tobytes() + b"".join(body)


def load(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 4 * n, 8).reshape(-1, 4).tolist()
    at, out = 8 + 32 * n, []
    for kind, size, count, packed in head:
        planes = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=max(1, size * count)) if count else b""
        raw = np.frombuffer(planes, np.uint8).reshape(size, count).T.tobytes() if count else b""
        out.append(np.frombuffer(raw, np.dtype(f"<{chr(kind)}{size}")))
        at += packed
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _batch(rows: list[Row]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=ROWS.fieldNames())


def grouped(rows: DataFrame, handle: Callable[[int, list[tuple[int, int, bytes]]], Iterator[Row]]) -> DataFrame:
    """Rows of a key, by kind and part, through `handle`; a key's rows are a shard's or block's arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for key, kind, part, data in zip(*(batch.column(c).to_pylist() for c in ROWS.fieldNames()), strict=True):
                if key != now:
                    if held:
                        yield from (_batch([r]) for r in handle(now, held))
                    now, held = key, []
                held.append((kind, part, data))
        if held:
            yield from (_batch([r]) for r in handle(now, held))

    return rows.repartition("key").sortWithinPartitions("key", "kind", "part").mapInArrow(run, ROWS)


# -- texts to word pairs ---------------------------------------------------


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    x = h + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    """56 bits name a word: of a billion words some seven pairs would share a name."""
    return xxhash.xxh3_64_intdigest(word) >> 8 or 1


def steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes: their top bytes are zero and take no room."""
    return np.diff(ordered, prepend=ordered[:1] * np.uint64(0))


def held_out(doc_id: int | None, folds: int = 5, fold: int = 1) -> bool:
    """Whether crc32 of the id as text falls in the fold; a null id is text 'null'."""
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % folds == fold


def _told(share: float):
    """Words of a task's texts that may be frequent, with how often they came; the number of all tokens as word -1.

    A word that makes up more than `share` of the corpus makes up as much of some
    tasks' texts; what tasks leave out of a word is under that share of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            # bytes are taken as they are, valid or not
            lower = pc.ascii_lower(batch.column("text").view(pa.string()))
            seen = pc.ascii_split_whitespace(lower).flatten().value_counts()
            seen = seen.filter(pc.greater(pc.binary_length(seen.field("values")), 0))
            n = seen.field("counts").to_numpy()
            total = int(n.sum()) + batch.num_rows  # with the ends
            often = np.flatnonzero(n >= total * share)
            words = seen.field("values").take(pa.array(often)).view(pa.binary()).to_pylist()
            h = np.fromiter(map(word_hash, words), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, [int(END), -1])), pa.array(np.append(n[often], [batch.num_rows, total]))], names=["word", "n"])

    return run


def frequent_contexts(texts: DataFrame, limit: int = CONTEXT_TOKENS) -> tuple[int, Ways]:
    """The number of tokens, and the words (by hash) that come more than about `limit` times, over how many parts each is spread.

    Counts are exact but for a quarter of the limit at most, so every word above
    it is found and none under three quarters.
    """
    least = texts.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(1.0))).first()[0]  # no more tokens than this
    share = min(1.0, limit / 4 / max(least, 1.0))
    counts = texts.select("text").mapInArrow(_told(share), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.where((F.col("word") < 0) | (F.col("n") > limit * 3 // 4)).limit(MOST_FREQUENT + 2).collect()
    if len(found) > MOST_FREQUENT + 1:
        raise ValueError(f"more than {MOST_FREQUENT} words come over {limit} times: raise SHARD_TOKENS with the memory of executors")
    told = {r.word: r.n for r in found}
    tokens = told.pop(-1, 0)
    words = np.array(sorted(told), np.int64).astype(np.uint64)
    return tokens, Ways(words, np.array([max(2, math.ceil(told[int(w)] / limit)) for w in words], np.uint64))


class Ways:
    """Over how many parts a context's dishes are dealt: one but for the words that are listed."""

    def __init__(self, words: np.ndarray, ways: np.ndarray):
        self.words, self.ways = np.append(words, np.uint64(np.iinfo(np.uint64).max)), np.append(ways, np.uint64(1))

    def of(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, words)
        return np.where(self.words[at] == words, self.ways[at], np.uint64(1))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of these texts in lower case, one text's after another's, and where each text's begin and end."""
    # bytes are taken as they are, valid or not
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    flat, edges = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty word
    return flat.filter(full), np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[edges]


def _pairs(shards: int, ways: Ways, texts: bool):
    """Blocks of texts to a row per shard with the block's word pairs, or to a row with the block's texts by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = number = 0
        parts: list[pa.Array] = []
        docs: list[tuple] = []
        held = weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, docs, held, weight, number
            if docs:
                yield from (_batch([r]) for r in _block(base | number, parts, docs, shards, ways, texts))
                parts, docs, held, weight, number = [], [], 0, 0, number + 1

        for batch in slices(batches, "text"):
            flat, edges = _words(batch.column("text"))
            edges, lengths = edges.tolist(), pc.binary_length(batch.column("text")).to_pylist()
            for uid, doc, length, begin, end in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id")), lengths, edges, edges[1:], strict=False):
                base = uid >> 33 << 24  # the partition of the texts, which a union doesn't renumber
                for at in range(begin, end + 1, BLOCK_TOKENS):  # a longer text in parts
                    size = min(BLOCK_TOKENS, end - at)
                    if held + size > BLOCK_TOKENS or weight + length > BLOCK_BYTES or len(docs) >= 1 << 18:
                        yield from flush()
                    follows, last = at > begin, at + BLOCK_TOKENS > end
                    parts.append(flat.slice(at - follows, size + follows))
                    docs.append((uid, doc or 0, doc is None, size + last, held_out(doc), follows, last))
                    held, weight = held + size + 1 + last, weight + length
        yield from flush()

    return run


def _block(number: int, parts: list[pa.Array], docs: list[tuple], shards: int, ways: Ways, texts: bool) -> Iterator[Row]:
    uid, doc, null, size, out, follows, last = (np.array(x) for x in zip(*docs, strict=True))
    told = pa.concat_arrays(parts).dictionary_encode()
    words = told.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    # words by the order of their hashes, so that pairs stand alike in every block
    names, rank = np.unique(np.concatenate(([END], np.fromiter(map(word_hash, words), np.uint64, len(words)))), return_inverse=True)
    # a part is its context (the word before it, else an end), its words, and an end where the text ends
    ends = np.cumsum(size + 1)
    first, final = np.zeros(ends[-1], bool), np.zeros(ends[-1], bool)
    first[ends - size - 1] = final[ends - 1] = True
    is_word = np.ones(ends[-1], bool)
    is_word[(ends - size - 1)[~follows]] = is_word[(ends - 1)[last]] = False
    token = np.full(ends[-1], rank[0])
    token[is_word] = rank[1:][told.indices.to_numpy()]
    owner, v, w = np.repeat(np.arange(len(size)), size), token[~final], token[~first]
    keys = v.astype(np.uint64) << np.uint64(41) | w.astype(np.uint64) << np.uint64(18) | owner.astype(np.uint64)
    keys.sort()
    fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(np.append(fresh, len(keys)))
    keys = keys[fresh]  # (context, word, text), with times
    pair = np.flatnonzero(np.concatenate(([True], (keys[1:] >> np.uint64(18)) != (keys[:-1] >> np.uint64(18)))))
    posts = np.diff(np.append(pair, len(keys)))
    v, w = (keys[pair] >> np.uint64(41)).astype(np.int64), (keys[pair] >> np.uint64(18) & np.uint64((1 << 23) - 1)).astype(np.int64)
    k = ways.of(names)[v]
    part = np.where(k > 1, mixed(mixed(names, 6)[w] % k, 7), np.uint64(0))
    shard = (mixed(names[v] ^ part, 8) % np.uint64(shards)).astype(np.int64)
    text = (keys & np.uint64((1 << 18) - 1)).astype(np.int64)
    train = np.add.reduceat(np.where(out[text], 0, times), pair)
    checks = mixed(mixed(names)[v] + names[w])
    asked, n, check, order = [], [], [], []
    for s, own in _by(shard):
        asked.append(s)
        n.append(len(own))
        check.append(np.bitwise_xor.reduce(checks[own]))
        order.append(own)
        if not texts:
            if len(own) < len(names) >> 5:  # one of many shards: its words are few
                used, at = np.unique(np.concatenate((v[own], w[own])), return_inverse=True)
                context, dish = at[: len(own)], at[len(own) :]
            else:
                used = np.zeros(len(names), bool)
                used[v[own]] = used[w[own]] = True
                at = np.cumsum(used) - 1
                context, dish = at[v[own]], at[w[own]]
            yield s, PAIRS, number, dump(steps(names[used]), narrow(np.diff(context, prepend=0)), narrow(dish), narrow(train[own]))
    if texts:
        order = np.concatenate(order)
        p = posts[order]
        where = np.repeat(pair[order] - (np.cumsum(p) - p), p) + np.arange(p.sum())
        asking = (np.array(asked), np.array(n), np.array(check, np.uint64))
        about = (uid.astype(np.int64), doc.astype(np.int64), null.astype(np.uint8), size.astype(np.int64), out.astype(np.uint8))
        yield number, TEXTS, 0, dump(*asking, *about, narrow(p), narrow(text[where]), narrow(times[where]))


def _by(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and where it stands."""
    if len(group) and group.max() < 1 << 16:
        group = group.astype(np.uint16)  # sorted by digits
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))) if len(group) else order
    for a, b in zip(edge, np.append(edge[1:], len(group)), strict=True):
        yield int(group[order[a]]), order[a:b]


# -- shards ------------------------------------------------------------------


def _owners(words: np.ndarray, owners: int) -> np.ndarray:
    return (mixed(words, 9) % np.uint64(owners)).astype(np.int64)


def _places(*owner: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Of each owner that is needed: which words of each list it answers for."""
    edges = np.cumsum([0, *map(len, owner)])
    for o, at in _by(np.concatenate(owner)):
        yield o, *(at[(at >= a) & (at < b)] - a for a, b in zip(edges, edges[1:], strict=False))


def _first(owners: int, ways: Ways):
    """A shard's pairs of all blocks to: its state for the sweeps, what the end needs, and questions to the owners."""

    def handle(shard: int, rows: list[tuple[int, int, bytes]]) -> Iterator[Row]:
        blobs = [(part, load(data)) for _, part, data in rows]
        hashes = [np.cumsum(b[0]) for _, b in blobs]
        words = np.unique(np.concatenate(hashes))
        keys = []
        for (_, (_, v, w, _)), own in zip(blobs, hashes, strict=True):
            at = np.searchsorted(words, own).astype(np.uint64)
            keys.append(at[np.cumsum(v.astype(np.int64))] << np.uint64(32) | at[w])
        pairs = np.unique(np.concatenate(keys))
        count = np.zeros(len(pairs), np.int64)
        for (part, b), k in zip(blobs, keys, strict=True):
            at = np.searchsorted(pairs, k)  # both are in order
            count[at] += b[3]
            v, w = words[k >> np.uint64(32)], words[k & np.uint64(0xFFFFFFFF)]
            yield shard, ANSWER, part, dump(narrow(np.diff(at, prepend=0)), np.array([np.bitwise_xor.reduce(mixed(mixed(v) + w))]))
        context = pairs >> np.uint64(32)
        fresh = np.concatenate(([True], context[1:] != context[:-1]))
        context_w, context = context[fresh], np.cumsum(fresh) - 1
        dish = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        met = np.zeros(len(words), bool)
        met[dish] = True
        dish_w, dish = np.flatnonzero(met), (np.cumsum(met) - 1)[dish]
        many = count > 1
        # dishes that can change stand first
        active = np.zeros(len(dish_w), bool)
        active[dish[many]] = True
        order = np.argsort(~active, kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        dish, dish_w, n_active = at[dish], dish_w[order], int(active.sum())
        dish_c = np.bincount(dish, count, len(dish_w)).astype(np.int64)
        dish_t = np.bincount(dish, count > 0, len(dish_w)).astype(np.int64)
        ctx_c = np.bincount(context, count, len(context_w)).astype(np.int64)
        single = np.bincount(context, count == 1, len(context_w)).astype(np.int64)
        split = np.flatnonzero(ways.of(words[context_w]) > 1)
        d_owner, s_owner = _owners(words[dish_w], owners), _owners(words[context_w[split]], owners)
        yield shard, STATE, 0, dump(
            narrow(np.diff(context[many], prepend=0)), narrow(dish[many]), narrow(count[many]), narrow(ctx_c), narrow(single),
            narrow(np.bincount(dish[count == 1], minlength=n_active)[:n_active]), narrow(split), narrow(d_owner[:n_active]), narrow(s_owner),
        )
        yield shard, FULL, 0, dump(narrow(np.diff(context, prepend=0)), narrow(dish), narrow(count), narrow(ctx_c), narrow(single), narrow(split), narrow(d_owner), narrow(s_owner))
        split_t = (single + np.bincount(context, many, len(context_w)).astype(np.int64))[split]
        for o, d, r, c in _places(d_owner[:n_active], d_owner[n_active:], s_owner):
            r = r + n_active
            yield o, ASK, shard, dump(narrow(dish_t[d]), narrow(split_t[c]))
            yield o, CONSTANT, shard, dump(words[dish_w[d]], words[dish_w[r]], words[context_w[split[c]]], narrow(dish_c[d]), narrow(dish_c[r]), narrow(dish_t[r]), narrow(ctx_c[split[c]]))
        yield shard, NUMBERS, 0, dump(np.array([np.count_nonzero(count == 1), np.count_nonzero(count == 2)], float))

    return handle


class Numbers:
    """What all owners and shards counted together, and the parameters of both levels."""

    def __init__(self, owned: np.ndarray, level: tuple[float, float], root: tuple[float, float]):
        self.tokens, self.words, self.customers, self.tables = (int(x) for x in owned[:4])
        self.level, self.root = level, root
        (self.theta, self.discount), (self.root_theta, self.root_discount) = level, root

    def under(self, other: Numbers) -> Numbers:
        """These counts with the parameters of others: those that the counts were drawn with."""
        return Numbers(np.array([self.tokens, self.words, self.customers, self.tables]), other.level, other.root)

    @property
    def base(self) -> float:
        return (self.root_theta + self.root_discount * self.tables) / (self.words + 1)

    def root_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.root_discount * tables + self.base) / (self.root_theta + self.customers)


def _replies(rows: list[tuple[int, int, bytes]], places: dict[int, tuple], sizes: tuple[int, int], dishes: int, contexts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The owners' answers back in the shard's order: so many arrays by dish, so many by split context."""
    by_dish, by_context = ([np.zeros(n, np.int64) for _ in range(k)] for n, k in zip(sizes, (dishes, contexts), strict=True))
    for kind, part, data in rows:
        if kind == REPLY:
            d, c = places[part]
            answers = load(data)
            for a, x in zip(by_dish, answers[:dishes], strict=True):
                a[d] = x
            for a, x in zip(by_context, answers[dishes:], strict=True):
                a[c] = x
    return by_dish, by_context


def _sweep(number: int, x: Numbers, seed: int, rounds: int):
    """State, seats and the owners' answers to: new seats, new questions, and draws for theta and the discount."""

    def handle(shard: int, rows: list[tuple[int, int, bytes]]) -> Iterator[Row]:
        rng = np.random.default_rng([seed, number, shard])
        step, dish, count, ctx_c, single, dish_1, split, d_owner, s_owner = (a.astype(np.int64) for a in load(next(d for k, _, d in rows if k == STATE)))
        context = np.cumsum(step)
        seats = Seats(count, *next((load(d) for k, _, d in rows if k == TABLES), ()))
        places = {o: (d, c) for o, d, c in _places(d_owner, s_owner)}
        (root, root_t), (split_c, split_t) = _replies(rows, places, (len(d_owner), len(split)), 2, 2)
        customers = ctx_c.copy()
        customers[split] = split_c

        def by(where: np.ndarray, base: np.ndarray) -> np.ndarray:
            return base + np.bincount(where, seats.tables, len(base)).astype(np.int64)

        own = by(dish, dish_1)
        elsewhere = root - own, split_t - by(context, single)[split]

        def weights(at: np.ndarray) -> Weights:
            tables = by(context, single)
            tables[split] += elsewhere[1]
            root_now = elsewhere[0] + by(dish, dish_1)
            here, d = seats.tables[at], dish[at]
            others = root_now[d] - here
            mass = others - x.root_discount * np.minimum(root_t[d], others + 1) + x.base
            total = x.root_theta + x.customers + (root_now - root).sum() - here
            return Weights(x.theta, x.discount, tables[context[at]] - here, mass, total)

        sweep(seats, weights, rng, rounds)
        yield shard, TABLES, number, dump(narrow(seats.tables), narrow(seats.sizes))
        dish_t, ctx_t = by(dish, dish_1), by(context, single)
        for o, (d, c) in places.items():
            yield o, ASK, shard, dump(narrow(dish_t[d]), narrow(ctx_t[split][c]))
        whole = np.ones(len(ctx_c), bool)
        whole[split] = False
        sums = theta_sums(customers[whole], ctx_t[whole], x.theta, x.discount, rng)
        yield shard, NUMBERS, number, dump(np.append(sums, discount_sum(seats.sizes, x.discount, rng)))

    return handle


def _owned(asks: list[tuple[int, list[np.ndarray]]], index: dict, dishes: np.ndarray, contexts: np.ndarray) -> None:
    """Add what the shards told to the tables of dishes and of split contexts."""
    for part, a in asks:
        for k, sums in ((0, dishes), (1, contexts)):
            np.add.at(sums, index[part][k], a[k].astype(np.int64))


def _answer(number: int, x: Numbers | None, seed: int, rounds: int):
    """An owner's words: tables over all shards are customers of the root, seated there; answers in the order asked."""

    def handle(owner: int, rows: list[tuple[int, int, bytes]]) -> Iterator[Row]:
        rng = np.random.default_rng([seed, number, owner, 1])
        asks = [(part, load(data)) for kind, part, data in rows if kind == ASK]
        if number == 0:
            told = [(part, load(data)) for kind, part, data in rows if kind == CONSTANT]
            words = np.unique(np.concatenate([k for _, a in told for k in a[:3]]))
            fixed, c_dish, c_ctx = (np.zeros(len(words), np.int64) for _ in range(3))
            index = {}
            for part, (d, r, s, cd, cr, tr, cs) in told:
                d, r, s = (np.searchsorted(words, k) for k in (d, r, s))
                index[part] = d, s
                for sums, at, n in ((c_dish, d, cd), (c_dish, r, cr), (fixed, r, tr), (c_ctx, s, cs)):
                    np.add.at(sums, at, n.astype(np.int64))
                yield owner, INDEX, part, dump(narrow(d), narrow(s))
                yield owner, REST, part, dump(narrow(r))
            yield owner, INDEX, -1, dump(narrow(fixed), narrow(c_dish), narrow(c_ctx))
            seats = None
        else:
            saved = {part: [a.astype(np.int64) for a in load(data)] for kind, part, data in rows if kind == INDEX}
            fixed, c_dish, c_ctx = saved.pop(-1)
            index = saved
            has, tables, sizes = load(next(data for kind, _, data in rows if kind == ROOT))
            seats = Seats(has, tables, sizes)
        root, contexts = fixed.copy(), np.zeros(len(fixed), np.int64)
        _owned(asks, index, root, contexts)
        if seats is None:
            seats = Seats(root, (root > 0).astype(np.int64), root[root > 0])
        else:
            seats.follow(root, rng)
            elsewhere = x.tables - int(tables.astype(np.int64).sum())

            def weights(at: np.ndarray) -> Weights:
                here = seats.tables[at]
                others = elsewhere + int(seats.tables.sum()) - here
                return Weights(x.root_theta, x.root_discount, others, np.full(len(at), 1.0), np.full(len(at), x.words + 1.0), 0)

            sweep(seats, weights, rng, rounds)
        yield owner, ROOT, number, dump(narrow(seats.count), narrow(seats.tables), narrow(seats.sizes))
        yield owner, LAST, number, dump(narrow(seats.count), narrow(seats.tables), narrow(contexts))
        for part, (d, s) in index.items():
            if not len(d) and not len(s):
                continue  # a shard that only asked once, at the start, doesn't wait for this owner
            yield part, REPLY, owner, dump(narrow(seats.count[d]), narrow(seats.tables[d]), narrow(c_ctx[s]), narrow(contexts[s]))
        sums = np.zeros(4)
        if x is not None:
            sums = np.append(theta_sums(c_ctx, contexts, x.theta, x.discount, rng), discount_sum(seats.sizes, x.root_discount, rng))
        yield owner, NUMBERS, number, dump(np.append(np.array([c_dish.sum(), np.count_nonzero(c_dish), root.sum(), seats.tables.sum()], float), sums))

    return handle


def _at_end(samples: list[int]):
    """Owners: to each shard, for all its dishes, how often they came and what the root held in each sample; likewise split contexts."""

    def handle(owner: int, rows: list[tuple[int, int, bytes]]) -> Iterator[Row]:
        index = {part: [a.astype(np.int64) for a in load(data)] for kind, part, data in rows if kind == INDEX}
        rest = {part: load(data)[0].astype(np.int64) for kind, part, data in rows if kind == REST}
        _, c_dish, c_ctx = index.pop(-1)
        last = {part: load(data) for kind, part, data in rows if kind == LAST}
        for part, (d, s) in index.items():
            d = np.concatenate((d, rest[part]))
            by_dish, by_context = [c_dish[d]], [c_ctx[s]]
            for k in samples:
                customers, tables, contexts = last[k]
                by_dish += [customers[d], tables[d]]
                by_context.append(contexts[s])
            yield part, REPLY, owner, dump(*map(narrow, by_dish), *map(narrow, by_context))

    return handle


def _score(samples: list[int], numbers: dict[int, Numbers]):
    """A shard's answers to the blocks: of each pair asked about, log10 of the averaged predictive probability, and how often the word came."""

    def handle(shard: int, rows: list[tuple[int, int, bytes]]) -> Iterator[Row]:
        step, dish, count, ctx_c, single, split, d_owner, s_owner = (a.astype(np.int64) for a in load(next(d for k, _, d in rows if k == FULL)))
        context = np.cumsum(step)
        # the owners' places: active dishes, then the rest, as they were asked
        active = np.zeros(len(d_owner), bool)
        active[dish[count > 1]] = True
        n_active = int(active.sum())
        places = {o: (np.concatenate((d, r + n_active)), c) for o, d, r, c in _places(d_owner[:n_active], d_owner[n_active:], s_owner)}
        by_dish, by_context = _replies(rows, places, (len(d_owner), len(split)), 1 + 2 * len(samples), 1 + len(samples))
        tables = {part: load(data)[0].astype(np.int64) for kind, part, data in rows if kind == TABLES}
        many = count > 1
        customers = ctx_c.copy()
        customers[split] = by_context[0]
        mean = np.zeros(len(count))
        for i, k in enumerate(samples):
            x = numbers[k]
            t = (count > 0).astype(np.int64)
            t[many] = tables[k]
            total = single + np.bincount(context[many], tables[k], len(single)).astype(np.int64)
            total[split] = by_context[1 + i]
            p0 = x.root_probability(by_dish[1 + 2 * i], by_dish[2 + 2 * i])[dish]
            mean += (count - x.discount * t + (x.theta + x.discount * total[context]) * p0) / (x.theta + customers[context])
        score = np.log10(mean / len(samples)).astype(np.float32)
        came = by_dish[0][dish]
        for kind, part, data in rows:
            if kind == ANSWER:
                step, check = load(data)
                at = np.cumsum(step.astype(np.int64))
                yield part, REPLY, shard, dump(score[at], narrow(came[at]), check)

    return handle


PER_TEXT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("uid", "doc_id")]
    + [T.StructField("held_out", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")]
    + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
)


def _per_text(tokens: int, words: int):
    """A block's texts and the shards' answers to a row per text (or part of a long one)."""

    def summed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        shards, n, check, uid, doc, null, size, out, posts, text, times = load(next(data for kind, _, data in rows if kind == TEXTS))
        answers = {part: load(data) for kind, part, data in rows if kind == REPLY}
        for s, k, c in zip(shards.tolist(), n.tolist(), check.tolist(), strict=True):
            if s not in answers or len(answers[s][0]) != k or int(answers[s][2][0]) != c:
                raise RuntimeError("the texts came in other blocks when they were read again")
        score, came = (np.concatenate([answers[s][i] for s in shards.tolist()]).astype(float) for i in (0, 1))
        pair = np.repeat(np.arange(len(score)), posts)
        base = np.log10((came + 0.5) / (tokens + 0.5 * (words + 1)))
        text = text.astype(np.int64)
        sums = [np.bincount(text, times * x[pair], len(uid)) for x in (came > 0, base, score)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(uid),
                pa.array(doc, mask=null.astype(bool)),
                pa.array(out.astype(bool)),
                pa.array(size),
                pa.array(np.rint(sums[0]).astype(np.int64)),
                pa.array(sums[1]),
                pa.array(sums[2]),
            ],
            names=PER_TEXT.fieldNames(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for key, kind, part, data in zip(*(batch.column(c).to_pylist() for c in ROWS.fieldNames()), strict=True):
                if key != now:
                    if held:
                        yield summed(held)
                    now, held = key, []
                held.append((kind, part, data))
        if held:
            yield summed(held)

    return run


def _summed(n: int):
    """The numbers of a task's shards or owners, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                total += load(data)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], names=["i", "x"])

    return run


def score_texts(documents: DataFrame, samples: int = 3, burn_in: int = 3, rounds: int = 8, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row.

    Documents whose held_out() is false are learnt from; all are scored.  Null
    and empty texts are an end alone.  Repeated rows count as often as they
    come.  Without training documents every word is unknown.  `burn_in` sweeps
    come before the `samples` that are averaged; in a sweep each pair has
    `rounds` / 2 customers reseated, and one exchange of tables.  The rows are
    read three times and must come in the same partitions and order, as a
    table's do; else the query fails (write what follows a shuffle first).
    """
    texts = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), text_bytes().alias("text"))
    tokens, ways = frequent_contexts(texts)
    shards = max(1, math.ceil(tokens / SHARD_TOKENS))
    owners = math.ceil(shards / OWNER_SHARDS)
    rng = np.random.default_rng(seed)

    def of(rows: DataFrame, *kinds: int) -> DataFrame:
        return rows.filter(F.col("kind").isin(*kinds))

    def counted(rows: DataFrame, n: int) -> np.ndarray:
        sums = of(rows, NUMBERS).select("data").mapInArrow(_summed(n), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(n)
        for r in sums:
            out[r.i] = r.x
        return out

    first = stored(grouped(texts.mapInArrow(_pairs(shards, ways, False), ROWS), _first(owners, ways)), "shards", "uncompressed")
    once, twice = counted(first, 2)
    begun = stored(grouped(of(first, ASK, CONSTANT), _answer(0, None, seed, rounds)), "answers", "uncompressed")
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    numbers = {0: Numbers(counted(begun, 8), (1.0, discount), (1.0, discount))}
    answers, seats, kept, past = begun, None, [], []
    for k in range(1, burn_in + samples + 1):
        x = numbers[k - 1]
        told = of(first, STATE).unionByName(of(answers, REPLY))
        swept = stored(grouped(told.unionByName(of(seats, TABLES)) if seats else told, _sweep(k, x, seed, rounds)), "sweep", "uncompressed")
        told = of(begun, INDEX).unionByName(of(swept, ASK)).unionByName(of(answers, ROOT))
        answered = stored(grouped(told, _answer(k, x, seed, rounds)), "answers", "uncompressed")
        shard_sums, owner_sums = counted(swept, 4), counted(answered, 8)
        ones, zeros, log_x = shard_sums[:3] + owner_sums[4:7]
        level = draw_parameters(ones, zeros, log_x, shard_sums[3], rng)
        root_sums = theta_sums(owner_sums[2:3].astype(np.int64), owner_sums[3:4].astype(np.int64), x.root_theta, x.root_discount, rng)
        root = draw_parameters(*root_sums, owner_sums[7], rng)
        numbers[k] = Numbers(owner_sums, level, root)
        if k > burn_in:
            kept.append((swept, answered))
        past.append((swept, answered))
        if k > 1 and k - 1 <= burn_in:
            dropped(*past[k - 2])  # a sweep before the samples, which nothing reads any more
        seats, answers = swept, answered
    drawn = range(burn_in + 1, burn_in + samples + 1)
    # a sample's seats belong with the parameters that it was drawn with
    told = of(begun, INDEX, REST)
    final = of(first, FULL, ANSWER)
    for swept, answered in kept:
        told, final = told.unionByName(of(answered, LAST)), final.unionByName(of(swept, TABLES))
    with_parameters = {k: numbers[k].under(numbers[k - 1]) for k in drawn}
    scored = grouped(final.unionByName(grouped(told, _at_end(list(drawn)))), _score(list(drawn), with_parameters))
    rows = scored.unionByName(texts.mapInArrow(_pairs(shards, ways, True), ROWS))
    by_text = rows.repartition("key").sortWithinPartitions("key", "kind", "part").mapInArrow(_per_text(numbers[0].tokens, numbers[0].words), PER_TEXT)
    whole = by_text.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(numbers[0].tokens).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"),
        F.sum("score").alias("score"),
    )
    return whole.drop("uid")


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token under the model and the base, of documents learnt from and held out."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
