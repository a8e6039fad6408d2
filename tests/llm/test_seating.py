"""The Gibbs moves against exact laws, and the whole model against a sampler that moves one customer at a time."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from structscore.llm import language_model as lm
from structscore.llm.seating import Seats, Weights, draw_parameters, lgamma, sweep, theta_sums


def exact_law(count: int, w: Weights) -> np.ndarray:
    """P(t tables) by counting all seatings."""
    d = w.discount
    ways = np.zeros((count + 1, count + 2))
    ways[1, 1] = 1
    for n in range(1, count):
        for t in range(1, n + 2):
            ways[n + 1, t] = ways[n, t - 1] + max(n - d * t, 0) * ways[n, t]
    p, opened = np.zeros(count + 1), 1.0
    for t in range(1, count + 1):
        if t > 1:
            opened *= w.opening(np.array([t - 1.0]))[0]
        p[t] = opened * ways[count, t]
    return p / p.sum()


def test_lgamma():
    x = np.array([0.02, 0.5, 1, 2, 3.3, 10, 100, 1e5])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=0, atol=1e-8)


@pytest.mark.parametrize("theta, discount, others, own, mass, step", [(1, 0.8, 0, 0.01, 1e3, 1), (0.5, 0.5, 3, 2.0, 50.0, 1), (2, 0.3, 40, 10, 60, 1), (1, 0.7, 0, 0.3, 1, 0), (1, 0.7, 20, 30, 3000, 1)])
@pytest.mark.parametrize("count", [2, 3, 7, 12])
def test_moves_keep_the_exact_law(count, theta, discount, others, own, mass, step):
    n = 4000
    rng = np.random.default_rng(count)
    w = Weights(theta, discount, np.full(n, float(others)), np.full(n, float(own)), np.full(n, float(mass)), step)
    want = exact_law(count, w)
    for rounds, renewals in ((8, 2), (4, 0)):
        seats, seen = Seats(np.full(n, count)), np.zeros(count + 1)
        sweeps = 40 if renewals else 20 * count
        for k in range(sweeps):
            sweep(seats, w.of, rng, rounds, renewals)
            if k >= sweeps // 2:
                seen += np.bincount(seats.tables, minlength=count + 1)
        assert (np.add.reduceat(seats.sizes, np.cumsum(seats.tables) - seats.tables) == count).all()
        assert 0.5 * np.abs(seen / seen.sum() - want).sum() < 0.02, (rounds, renewals)


def test_large_counts_mix_alike():
    n = 3000
    w = Weights(0.5, 0.5, np.full(n, 3.0), np.full(n, 2.0), np.full(n, 50.0))
    want = exact_law(150, w)
    seats, seen, rng = Seats(np.full(n, 150)), np.zeros(151), np.random.default_rng(1)
    for k in range(40):
        sweep(seats, w.of, rng)
        seen += np.bincount(seats.tables, minlength=151) * (k >= 20)
    assert 0.5 * np.abs(seen / seen.sum() - want).sum() < 0.02


def test_customers_follow_a_new_count():
    rng = np.random.default_rng(2)
    seats = Seats(np.array([5, 9, 1, 40]), np.array([2, 3, 1, 2]), np.array([2, 3, 4, 4, 1, 1, 39, 1]))
    seats.follow(np.array([7, 2, 1, 1]), rng)
    assert np.add.reduceat(seats.sizes, np.cumsum(seats.tables) - seats.tables).tolist() == [7, 2, 1, 1]
    assert seats.sizes.min() > 0 and len(seats.sizes) == seats.tables.sum()


def test_parameters_are_found_again():
    """theta and d of restaurants that were seated with known ones."""
    rng = np.random.default_rng(4)
    theta, d, drawn = 3.0, 0.4, []
    sizes = []
    for _ in range(300):
        own = [1]
        for n in range(1, 200):
            p = np.array([*[s - d for s in own], theta + d * len(own)])
            k = rng.choice(len(p), p=p / p.sum())
            own[k : k + 1] = [own[k] + 1] if k < len(own) else [1]
        sizes.append(own)
    customers, tables = np.full(300, 200), np.array([len(s) for s in sizes])
    flat = np.array([n for s in sizes for n in s])
    a, b = 1.0, 0.7
    for k in range(300):
        ones, zeros, x = theta_sums(customers, tables, a, b, rng)
        from structscore.llm.seating import discount_sum

        a, b = draw_parameters(ones, zeros, x, discount_sum(flat, b, rng), rng)
        drawn.append((a, b))
    found = np.mean(drawn[100:], 0)
    assert abs(found[0] - theta) < 0.5 and abs(found[1] - d) < 0.05, found


# -- the whole model ------------------------------------------------------------


def one_by_one(pairs: list[tuple[int, int]], words: int, theta: float, d: float, sweeps: int, seed: int) -> dict[tuple[int, int], float]:
    """Averaged predictive probabilities of a textbook sampler: tables as lists, one customer at a time, parents included."""
    rng = np.random.default_rng(seed)
    seats: dict = defaultdict(lambda: defaultdict(list))  # restaurant -> dish -> table sizes; None is the root

    def p(v, w):
        r = seats[v]
        c, t = sum(map(sum, r.values())), sum(map(len, r.values()))
        parent = p(None, w) if v is not None else 1 / (words + 1)
        own = r.get(w, [])
        return (sum(own) - d * len(own) + (theta + d * t) * parent) / (theta + c)

    def add(v, w):
        r = seats[v]
        t = sum(map(len, r.values()))
        parent = p(None, w) if v is not None else 1 / (words + 1)
        weight = np.array([*[n - d for n in r[w]], (theta + d * t) * parent])
        k = rng.choice(len(weight), p=weight / weight.sum())
        if k < len(r[w]):
            r[w][k] += 1
        else:
            r[w].append(1)
            if v is not None:
                add(None, w)

    def remove(v, w):
        r = seats[v]
        own = np.array(r[w])
        k = rng.choice(len(own), p=own / own.sum())
        r[w][k] -= 1
        if not r[w][k]:
            del r[w][k]
            if v is not None:
                remove(None, w)

    for v, w in pairs:
        add(v, w)
    mean: dict = defaultdict(float)
    grid = [(v, w) for v in {v for v, _ in pairs} for w in {w for _, w in pairs}]
    for k in range(2 * sweeps):
        for v, w in pairs:
            remove(v, w)
            add(v, w)
        if k >= sweeps:
            for v, w in grid:
                mean[v, w] += p(v, w) / sweeps
    return mean


def by_key(rows):
    out = defaultdict(list)
    for key, kind, part, data in sorted(rows, key=lambda r: r[:3]):
        out[key].append((kind, part, data))
    return out


def through(handle, *rows):
    return [r for key, held in by_key([x for own in rows for x in own]).items() for r in handle(key, held)]


def of(rows, *kinds):
    return [r for r in rows if r[1] in kinds]


def counted(rows):
    return np.sum([lm.load(r[3])[0] for r in of(rows, lm.NUMBERS)], 0)


def in_process(texts: list[tuple[int, str]], shards: int, owners: int, burn_in: int, samples: int, fixed: tuple[float, float]):
    """The steps of score_texts on lists of rows, with fixed parameters: pairs of (pair hash names, log10 probability)."""
    ways = lm.Ways(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([i for i, _ in texts], pa.int64()), pa.array([t.encode() for _, t in texts])], names=["uid", "doc_id", "text"])
    if shards > 1:
        known = np.unique(np.array([int(lm.END), *[lm.word_hash(w) for _, t in texts for w in t.lower().encode().split()]], np.uint64))
        ways = lm.Ways(known, np.full(len(known), 4, np.uint64))  # all contexts are dealt by dish
    rows = [r for texts_too in (False, True) for b in lm._pairs(shards, ways, texts_too)(iter([batch])) for r in zip(*(b.column(c).to_pylist() for c in lm.ROWS.fieldNames()), strict=True)]
    first = through(lm._first(owners, ways), of(rows, lm.PAIRS))
    begun = through(lm._answer(0, None, 1, 8), of(first, lm.ASK, lm.CONSTANT))
    numbers = {0: lm.Numbers(counted(begun), fixed, fixed)}
    answers, seats, kept = begun, [], []
    drawn = range(burn_in + 1, burn_in + samples + 1)
    for k in range(1, burn_in + samples + 1):
        swept = through(lm._sweep(k, numbers[k - 1], 1, 8), of(first, lm.STATE), of(answers, lm.REPLY), of(seats, lm.TABLES))
        answers = through(lm._answer(k, numbers[k - 1], 1, 8), of(begun, lm.INDEX), of(swept, lm.ASK), of(answers, lm.ROOT))
        numbers[k] = lm.Numbers(counted(answers), fixed, fixed)
        seats = swept
        if k in drawn:
            kept.append((of(swept, lm.TABLES), of(answers, lm.LAST)))
    told = through(lm._at_end(list(drawn)), of(begun, lm.INDEX, lm.REST), *[x for _, x in kept])
    scored = through(lm._score(list(drawn), numbers), of(first, lm.FULL, lm.ANSWER), told, *[x for x, _ in kept])
    held = [(kind, part, data) for _, kind, part, data in sorted(scored + of(rows, lm.TEXTS), key=lambda r: r[:3])]
    size = counted(begun)
    blocks = [pa.RecordBatch.from_arrays([pa.array([0] * len(held), pa.int64()), pa.array([k for k, _, _ in held], pa.int32()), pa.array([p for _, p, _ in held], pa.int64()), pa.array([d for _, _, d in held], pa.binary())], names=lm.ROWS.fieldNames())]
    return [r for b in lm._per_text(int(size[0]), int(size[1]))(iter(blocks)) for r in b.to_pylist()]


@pytest.mark.parametrize("shards, owners", [(1, 1), (3, 2)])
def test_scores_are_those_of_a_sampler_one_customer_at_a_time(shards, owners):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e"], rng.integers(3, 12), p=[0.4, 0.3, 0.15, 0.1, 0.05]))) for i in range(40)]
    theta, d = 1.0, 0.5
    pairs = [(v, w) for i, t in texts if not lm.held_out(i) for v, w in zip(["", *t.split()], [*t.split(), ""], strict=True)]
    words = len({w for _, w in pairs})
    want = one_by_one(pairs, words, theta, d, 150, 3)
    got = in_process(texts, shards, owners, 20, 120, (theta, d))
    assert len(got) == len(texts)
    for r in got:
        tokens = dict(texts)[r["doc_id"]].split()
        exact = sum(math.log10(want[v, w]) for v, w in zip(["", *tokens], [*tokens, ""], strict=True))
        assert abs(r["score"] - exact) < 0.02 * (len(tokens) + 1), (r, exact)


def test_frequent_contexts_are_counted_exactly(spark, monkeypatch):
    """Every word above the limit is found in any cut of the texts, and no word under three quarters of it."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 400) if i < 10**6) for _ in range(300)] + ["rare"] * 50
    df = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    exact = Counter(w for t in texts for w in t.split())
    for limit, parts in ((500, 1), (500, 7), (60, 3), (10**9, 2)):
        tokens, ways = lm.frequent_contexts(df.repartition(parts), limit)
        assert tokens == sum(exact.values()) + len(texts)
        names = {lm.word_hash(w.encode()): n for w, n in exact.items()} | {int(lm.END): len(texts)}
        found = set(ways.words[:-1].tolist())
        assert {h for h, n in names.items() if n > limit} <= found and all(names[h] > limit * 3 / 4 - 1 for h in found)
        assert (ways.of(np.array(sorted(names), np.uint64)) > 1).sum() == len(found)
    monkeypatch.setattr(lm, "MOST_FREQUENT", 1)
    with pytest.raises(ValueError, match="SHARD_TOKENS"):
        lm.frequent_contexts(df, 60)
    assert lm.frequent_contexts(df.limit(0))[0] == 0


def test_the_average_context_is_not_split_however_large_the_corpus():
    """A word's parts depend on its own count alone."""
    ways = lm.Ways(np.array([5, 9], np.uint64), np.array([2, 40], np.uint64))
    assert ways.of(np.array([1, 5, 7, 9, 2**55], np.uint64)).tolist() == [1, 2, 1, 40, 1]


def test_split_contexts_score_as_whole_ones(spark, monkeypatch):
    """With a low limit most contexts are spread over shards; held-out scores stay those of whole ones, but for the sampler's noise."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k % 40}" for k in rng.zipf(1.5, 120))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    whole = {r.doc_id: r for r in lm.score_texts(df).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    monkeypatch.setattr(lm.frequent_contexts, "__defaults__", (500,))
    split = {r.doc_id: r for r in lm.score_texts(df).collect()}
    assert all(whole[i][c] == split[i][c] for i in whole for c in ("n_tokens", "n_known", "train_tokens"))
    assert all(abs(whole[i].base_score - split[i].base_score) < 1e-6 for i in whole)
    total = lambda x: sum(r.score for r in x.values())
    assert abs(total(split) / total(whole) - 1) < 0.02


def test_an_owner_of_words_that_came_once_is_asked_once():
    """An owner whose words of a shard all came once has nothing to answer between sweeps."""
    texts = [(i, f"a b{i} c{i} d{i} a a") for i in range(12)]
    got = in_process(texts, 3, 9, 1, 1, (1.0, 0.5))
    assert sorted(r["doc_id"] for r in got) == list(range(12)) and all(r["score"] < 0 for r in got)


def test_blocks_are_bounded_by_bytes_too(monkeypatch):
    """Long words, odd bytes and white space of every kind: blocks hold few bytes, and all pairs whatever the blocks."""
    texts = [b"x" * 900, b" \x0bA b\x0c", b"", b"\xff\xc3 B\x1cB\x85 a", b"x" * 900 + b" a b", b"a b " * 300]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "text"])
    ways = lm.Ways(np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def told():
        rows = [r for b in lm._pairs(1, ways, False)(iter([batch])) for r in zip(*(b.column(c).to_pylist() for c in lm.ROWS.fieldNames()), strict=True)]
        pairs = Counter()
        for _, _, _, data in rows:
            words, v, w, n = lm.load(data)
            names = np.cumsum(words)
            for a, b, k in zip(names[np.cumsum(v.astype(int))].tolist(), names[w].tolist(), n.tolist(), strict=True):
                pairs[a, b] += k
        return len(rows), pairs

    want = Counter()
    for i, t in zip(columns[1].to_pylist(), texts, strict=True):
        h = [0, *map(lm.word_hash, t.lower().split()), 0]
        for pair in zip(h, h[1:], strict=False):
            want[pair] += not lm.held_out(i)
    assert told() == (1, want)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1000)
    few, pairs = told()
    assert few == 3 and pairs == want
