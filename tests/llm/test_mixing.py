"""The mix against plain Python: targets by repeated resharing, words taken, the schedule itself."""

from __future__ import annotations

import random
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import frame, odd_rows
from pyspark.sql import functions as F

from structscore.llm import mixing


def plain_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Shares by weight; who is over stops, and the excess is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        per = Fraction(left, sum(weight[s] for s in open_)) if open_ else 0
        over = [s for s in open_ if per * weight[s] > most * sizes[s]]
        if not over:
            return {s: stopped.get(s, per * weight[s] if s in open_ else 0) for s in names}
        stopped |= {s: most * sizes[s] for s in over}


def with_sources(spark, rows):
    """Odd documents; most are of one source, one source has a word, some rows have none."""
    rnd = random.Random(3)
    pick = lambda k: "hot" if k % 3 else rnd.choice([None, "b", "Ä", "", "z"])
    data = [(i, t, pick(k), "x") for k, (i, t) in enumerate(rows)] + [(900, "word", "small", "x"), (901, " ", "empty", "x")]
    return data, spark.createDataFrame(data, "doc_id bigint, text string, source string, position string").repartition(3)


def words(text) -> int:
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_takes_targets(spark):
    data, docs = with_sources(spark, odd_rows())
    rows = mixing.mix_report(docs, 16).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((i, words(t), s) for i, t, s, _ in data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = plain_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    assert all(taken[s] == int(want[s]) for s in want)
    # neither the cut of the input nor the size of blocks plays a part
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(docs.repartition(5), 2048).collect()))


def test_schedule_is_even(spark):
    """Every stretch of the schedule holds the sources nearly in their shares, and blocks come pass after pass."""
    data, docs = with_sources(spark, odd_rows())
    pieces = mixing.mixed_pieces(docs, 16).orderBy("slot", "in_block").collect()
    slots = sorted({(r.slot, r.source or "") for r in pieces})
    share = Counter(s for _, s in slots)
    for n in (len(slots) // 4, len(slots) // 2):
        seen = Counter(s for _, s in slots[:n])
        assert all(abs(seen[s] - n * share[s] / len(slots)) < 8 for s in share)
    by_slot = defaultdict(int)
    for r in pieces:
        assert r.in_block == by_slot[r.slot]
        by_slot[r.slot] += r.length
    assert max(by_slot.values()) == 16
    taken = Counter()
    for r in pieces:
        taken[r.doc_id] += r.length
    report = Counter()
    for r in mixing.mix_report(docs, 16).collect():
        report[r.doc_id] += r.taken
    assert taken == +report


def test_points(spark):
    points = [r[0] for r in spark.range(8).select(mixing.van_der_corput(F.col("id"))).collect()]
    assert [p >> (mixing.BITS - 3) for p in points] == [0, 4, 2, 6, 1, 5, 3, 7]


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert mixing.mix_report(empty).count() == 0
    none = mixing.mix_report(frame(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.taken, r.target) for r in none] == [(0, 0, 0.0)] * 2
