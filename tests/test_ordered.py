"""Work along an order and trees of any size, against plain Python and at sizes that windows per key can't hold."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from structscore.operators import forest, ordered


@pytest.fixture(scope="module")
def sides():
    """Two tables with a key that holds half of the rows, null keys and positions, ties and repeated rows."""
    rnd = random.Random(4)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", "", None, "lone-" + rnd.choice("xyz")])
    left = [(key(), rnd.choice([None, rnd.randint(0, 300)] + [rnd.randint(0, 300)] * 8), i) for i in range(700)]
    right = [(key(), rnd.choice([None, rnd.randint(0, 300)] + [rnd.randint(0, 300)] * 8), i) for i in range(150)]
    return left + left[:5], right + right[:5] + [("only-right", 1, 900)]


def plain_nearest(left, right, within, direction):
    out = []
    for k, p, i in left:
        near = [(abs(p - q), q, j) for c, q, j in right if c == k and k is not None and p is not None and q is not None and (direction == "nearest" or (q <= p) == (direction == "backward") or q == p)]
        best = min(near, default=None)
        out.append((k, p, i, best[2] if best and (within is None or best[0] <= within) else None))
    return Counter(out)


@pytest.mark.parametrize(("within", "direction"), [(None, "nearest"), (3, "nearest"), (None, "backward"), (2, "forward")])
def test_nearest_join(spark, sides, within, direction):
    left, right = sides
    a = spark.createDataFrame(left, "key string, at long, id long").repartition(3)
    b = spark.createDataFrame(right, "key string, at long, id long").repartition(2)
    found = ordered.nearest_join(a, b, ["key"], "at", "id", within, direction)
    assert Counter((r.key, r.at, r.id, r.match.id if r.match else None) for r in found.collect()) == plain_nearest(left, right, within, direction)
    assert ordered.nearest_join(a.limit(0), b, ["key"], "at", "id").count() == 0
    assert ordered.nearest_join(a, b.limit(0), ["key"], "at", "id").where("match IS NOT NULL").count() == 0


def test_nearest_join_spreads_a_hot_key(spark):
    """One key holds half of 400,000 rows, and every task has a share of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"), (F.col("id") * 7).alias("at"), "id")
        found = ordered.nearest_join(rows, rows.where("id % 3 = 0"), ["key"], "at", "id")
        wrong = found.where("key = 0 AND id % 6 = 0 AND NOT match.id <=> id OR key = 0 AND id % 6 = 2 AND NOT match.id <=> id - 2 OR key = 0 AND id % 6 = 4 AND id < 399990 AND NOT match.id <=> id + 2")
        assert wrong.count() == 0 and found.count() == 400_000
        line = ordered.lined(rows, ["key", "at"])
        assert line.where("key = 0").select(ordered.PART).distinct().count() >= 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_previous_totals_and_clusters(spark, sides):
    rows = [(k, p, i) for i, (k, p, _) in enumerate(sides[0])]
    df = spark.createDataFrame(rows, "key string, at long, id long").repartition(3)
    rank = lambda x: (x is not None, x)
    line = sorted(rows, key=lambda r: (rank(r[0]), r[2]))
    laid = ordered.lined(df, ["key", "id"])
    got = {r.id: (r.last, r.total) for r in ordered.with_total(ordered.with_previous(laid, ["key"], ["id"], {"last": F.col("id")}), ["key", "id"], F.col("at"), "total").collect()}
    total, last = 0, {}
    for k, p, i in line:
        assert got[i] == (last.get(k), total)
        last[k], total = i, total + (p or 0)
    clusters = {r.id: r.cluster for r in ordered.gap_clusters(df, ["key"], "at", 1).collect()}
    state = {}
    for k, p, i in sorted(rows, key=lambda r: (rank(r[0]), rank(r[1]))):
        if k not in state:
            state[k] = (p, 0)
        q, n = state[k]
        state[k] = (p, n + ((q is None) != (p is None) or p is not None and p - q > 1))
        assert clusters[i] == state[k][1], (k, p)


def test_order_statistics(spark, sides):
    rows = [(k, float(p) if p is not None else None) for k, p, _ in sides[0]]
    got = {r.key: tuple(r)[1:] for r in ordered.order_statistics(spark.createDataFrame(rows, "key string, v double").repartition(3), ["key"], "v").collect()}
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    want = {}
    for k, v in values.items():
        v.sort()
        n = len(v)
        want[k] = (n, v[0], v[n // 4], v[n // 2], v[3 * n // 4], v[-1])
    assert got == want
    one = spark.range(100_000).select(F.lit("hot").alias("key"), F.col("id").alias("v"))
    assert tuple(ordered.order_statistics(one, ["key"], "v").first()) == ("hot", 100_000, 0, 25_000, 50_000, 75_000, 99_999)


def plain_runs(values, tolerance):
    """(start, n) of maximal runs in a list of (order, value)."""
    runs, k = [], 0
    while k + 1 < len(values):
        j = k + 1
        while j + 1 < len(values) and abs((values[j + 1][1] - values[j][1]) - (values[j][1] - values[j - 1][1])) <= tolerance:
            j += 1
        runs.append((values[k][0], j - k + 1, values[k][1], values[k + 1][1] - values[k][1]))
        k = j
    return runs


@pytest.mark.parametrize("tolerance", [0, 3])
def test_arithmetic_runs(spark, tolerance):
    rnd = random.Random(9)
    rows = [(rnd.choice("hhhab"), i, rnd.choice([None, i * 3, i * 3, rnd.randint(0, 9)])) for i in range(500)] + [("one", 1, 5), ("none", 1, None)]
    df = spark.createDataFrame(rows, "key string, at long, v long").repartition(3)
    got, best = defaultdict(list), {}
    for r in ordered.arithmetic_runs(df, ["key"], "at", "v", tolerance).orderBy("start").collect():
        got[r.key].append((r.start, r.n, r.first, r.step))
    for key in "hab":
        want = plain_runs([(i, v) for k, i, v in rows if k == key and v is not None], tolerance)
        assert got[key] == want
        best[key] = max(want, key=lambda r: (r[1], -r[0]))
    assert set(got) == set(best)
    assert {r.key: (r.start, r.n, r.first, r.step) for r in ordered.longest_runs(df, ["key"], "at", "v", tolerance).collect()} == best


def test_monotonic_keys_and_runs_of_messages(spark, sides):
    rnd = random.Random(11)
    rows = [("up", i, i, "m") for i in range(50)] + [("down", i, -i, "m") for i in range(50)] + [("flat", 0, 1, None), ("flat", 1, 1, None), ("one", 0, 1, "x"), ("null", 0, 1, "x"), ("null", 1, None, None), ("null", 2, 3, "x")]
    rows += [("mix", i, rnd.randrange(5), rnd.choice("aab")) for i in range(80)]
    df = spark.createDataFrame(rows, "key string, at long, v long, m string").repartition(3)
    assert {r.key: r.monotonic for r in ordered.monotonic(df, ["key"], ["at"], "v").collect()} == {"up": True, "down": True, "flat": False, "one": False, "null": False, "mix": False}
    want = []
    for key in ("up", "down", "flat", "one", "null", "mix"):
        own, k = [(a, m) for q, a, _, m in rows if q == key], 0
        while k < len(own):
            n = 1
            while k + n < len(own) and own[k + n][1] == own[k][1]:
                n += 1
            m = own[k][1]
            want.append((key, own[k][0], m if n == 1 or m is None else f"{m} [Repeat x{n}]", n))
            k += n
    assert Counter(map(tuple, ordered.run_lengths(df, ["key"], "at", "m").collect())) == Counter(want)


def test_trees(spark):
    """Odd rows: orphans, own parents, circles and what hangs on them, repeated and null ids."""
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 99, "orphan"), (5, 4, "e"), (6, 6, "self"), (7, 6, "g"), (8, 9, "circle"), (9, 10, "circle"), (10, 8, "circle"), (11, 10, "hangs"), (None, 1, "null"), (2, 1, "b"), (3, 5, "c"), (12, 3, None)]
    df = spark.createDataFrame(rows, "id long, parent long, name string").repartition(3)
    got = {r.id: (r.depth, r.root, r.path) for r in forest.rooted(df, "name").collect()}
    assert got == {1: (0, 1, ["a"]), 2: (1, 1, ["a", "b"]), 3: (2, 1, ["a", "b", "c"]), 4: (0, 4, ["orphan"]), 5: (1, 4, ["orphan", "e"]), 6: (0, 6, ["self"]), 7: (1, 6, ["self", "g"]), 12: (3, 1, ["a", "b", "c", None])}
    assert forest.rooted(df.limit(0)).count() == 0
    only_circles = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long")
    assert forest.rooted(only_circles).count() == 0


def test_two_million_rows_and_a_long_chain(spark):
    """2,000,000 rows, a third of them children of one row, and a chain of depth 5,000."""
    rows = spark.range(2_000_000).select("id", F.expr("CASE WHEN id = 0 THEN NULL WHEN id <= 5000 THEN id - 1 WHEN id % 3 = 0 THEN 5000 ELSE id div 2 END").alias("parent"))
    found = forest.rooted(rows).cache()
    assert found.count() == 2_000_000
    assert found.agg(F.max("depth"), F.min("root"), F.max("root")).first()[1:] == (0, 0)
    assert found.where("id = 5000").first().depth == 5000 and found.where("id = 300000").first().depth == 5001
    up = found.select(F.col("id").alias("parent"), F.col("depth").alias("above"))
    assert rows.join(found, "id").join(up, "parent").where("depth <> above + 1").count() == 0
    found.unpersist()
