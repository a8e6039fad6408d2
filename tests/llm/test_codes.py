"""Vector codes against Lloyd's rounds in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from structscore.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, whole string"


def plain_codes(rows: list[tuple], width: int) -> list[tuple]:
    """vec_id, code, error, label_error, digest of every kept row, by comparing all parts with all entries."""
    kept = [(i, [math.floor(1024 * x) for x in v], c) for i, v, c in rows if v is not None and len(v) == 4 * width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    code, error, numbers = defaultdict(str), Counter(), []
    for p in range(4):
        cut = slice(p * width, (p + 1) * width)
        book = [r[1][cut] for r in first]
        nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, z, strict=True)), e) for e, z in enumerate(book))  # noqa: B023, E731
        for _ in range(4):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[nearest(v[cut])[1]].append(v[cut])
            book = [[sum(c) // len(c) for c in zip(*got[e], strict=True)] if got[e] else z for e, z in enumerate(book)]
        for k, (_, v, _) in enumerate(kept):
            d, e = nearest(v[cut])
            code[k] += f"{e:02x}"
            error[k] += d
        numbers += [str(x) for z in book for x in z]
    by_label = Counter()
    for k, (_, _, c) in enumerate(kept):
        by_label[c] += error[k]
    digest = hashlib.sha256(",".join(numbers).encode()).hexdigest()
    return [(i, code[k], error[k], by_label[c], digest) for k, (i, _, c) in enumerate(kept)]


def vectors(n: int, width: int) -> list[tuple]:
    rnd = random.Random(n)
    some = lambda: [float(np.float32(rnd.choice([rnd.gauss(0, 0.2), 0.25, -0.5]))) for _ in range(4 * width)]
    rows = [(rnd.randrange(10 * n), some(), rnd.choice([None, 1, 1, 1, 2])) for _ in range(n)]
    rows += [(rows[0][0], rows[1][1], 7), rows[2], rows[2], *[(5000 + i, rows[3][1], 1) for i in range(n // 3)]]  # ties, copies, a hot vector
    rows += [(None, some(), None), (1, None, 1), (2, [float("nan")] * (4 * width), 1), (3, [float("inf")] + [0.0] * (4 * width - 1), 1), (4, [None] + [0.0] * (4 * width - 1), 1)]
    return [*rows, (10**12, [0.5] * 3, 1), (10**12, [], 2)]


@pytest.mark.parametrize(("n", "width"), [(700, 2), (40, 1)])
def test_equals_plain_rounds(spark, monkeypatch, n, width):
    monkeypatch.setattr(codes, "PAIRS", 300)
    rows = vectors(n, width)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = codes.codes_report(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(plain_codes(rows, width))


def test_trees_give_the_nearest_entry():
    rnd = np.random.default_rng(1)
    for n, width, entries, spread in ((1, 3, 1, 9), (4000, 8, 200, 90), (600, 2, 7, 3), (3000, 1, 50, 40)):
        points = np.floor(rnd.standard_normal((n, width)) * spread).astype(np.int64)
        book = np.ascontiguousarray(points[:entries])
        tree = codes.build_tree(points)
        want = ((points[tree["order"]][:, None] - book) ** 2).sum(2).argmin(1)
        found, sums, counts = np.zeros(n, np.int64), np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        codes.assign(tree, book, codes=found)
        codes.assign(tree, book, sums, counts)
        all_sums = np.zeros_like(sums)
        np.add.at(all_sums, want, points[tree["order"]])
        assert (found == want).all() and (sums == all_sums).all() and (counts == np.bincount(want, minlength=len(book))).all()


def test_odd_tables(spark):
    assert codes.codes_report(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, 1, "", ""), (2, [float("nan")] * 4, 1, "", "")], SCHEMA)
    assert codes.codes_report(none).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 0.0, -1e30, 1.0], 1, "", ""), (2, [0.0] * 4, None, "", "")], SCHEMA)
    assert [r.error for r in codes.codes_report(huge).collect()] == [0, 0]
    empty = codes.codes_report(spark.createDataFrame([(1, [], 1, "", "")], SCHEMA)).collect()
    assert [(r.code, r.error) for r in empty] == [("00000000", 0)]
