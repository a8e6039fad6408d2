"""Collocations against plain counting, with small blocks, shards' limits and thresholds."""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from structscore.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, block string, phrase string, n string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_phrases(rows: list[tuple], least: int, first: int) -> list[tuple]:
    """COLUMNS by counting everything, and looking at all longer candidates."""
    counts, n = Counter(), Counter()
    for _, text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        counts["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    f = {key: a for key, a in counts.items() if a >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) == 1:
            continue
        inside = any(la == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (la, q), b in f.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, place = [], Counter()
    for lang, *rest in out:
        place[lang] += 1
        if place[lang] <= first:
            ranked.append((lang, place[lang], *rest))
    return ranked


def texts() -> list[tuple]:
    rnd = random.Random(8)
    words = ["a", "A", "b", "ab", "Épée", "x-1", "日本", "(", "\x1c", "\xa0y", "und", "a" * 60]
    say = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0c"]) for _ in range(n))
    rows = [(i, say(rnd.randint(0, 60)), rnd.choice(["en", "en", "en", None, "und", "", "de"])) for i in range(150)]
    rows += [(1, None, "en"), (None, "", None), (2, " \t ", "fr"), (3, "...", "fr"), rows[0], rows[0]]
    rows += [(4, "a a a a a a a a a a a a", "es"), (5, say(4000), "de"), *[(6, "kept together here always, kept together here", "it")] * 9]
    return rows


@pytest.mark.parametrize(("least", "first", "block"), [(5, 2000, 300), (3, 7, 1 << 20), (300, 50, 2000)])
def test_equals_counting(spark, least, first, block):
    rows = texts()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, phrases.collocations(df, least, first, block).select(COLUMNS).collect()))
    assert got == sorted(plain_phrases(rows, least, first)) and (got or least == 300)


def test_sketch_is_an_upper_bound(spark):
    """With very few counters all of a frequent phrase's counters still reach the threshold."""
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in texts()], SCHEMA)
    blocks = phrases.stored(phrases.text_blocks(df, 500), "blocks")
    sums = Counter()
    for row in blocks.collect():
        cells, counts = phrases.Block(row.lang, row.words, row.ids).touched(1 << 16)
        sums.update(dict(zip(cells.tolist(), counts.tolist(), strict=True)))
    want = Counter({r.block: 0 for r in blocks.select("block").collect()})
    for row in blocks.collect():
        cells, _ = phrases.Block(row.lang, row.words, row.ids).touched(1 << 16)
        want[row.block] = sum(sums[c] >= 5 for c in cells.tolist())
    got = Counter()
    for row in phrases.sketched(blocks, 1 << 16, 5).collect():
        got[row.block] += sum(b.bit_count() for b in row.bits)
    assert +want == got


def test_empty_tables(spark):
    empty = phrases.collocations(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == COLUMNS
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", "", "")], SCHEMA)).count() == 0
