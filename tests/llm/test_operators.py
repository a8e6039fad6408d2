"""Each operator against plain Python, on texts with every odd case."""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain

from structscore.llm import decontaminate, grammar, language_model, line_dedup, packing, quality, repeats, secrets, simhash, warc

#: Columns whose names clash with those that operators make on the way.
EXTRA = "source string, row_hash string, key string, n_words string, drops string, fp string, component_id string, uid string, state string"


def odd_rows() -> list[tuple]:
    rnd = random.Random(5)
    words = ["the", "of", "Gamma", "DELTA", "épée", "ß", "x1", "and", "a#b", "|", "***", "to", "日本", "naïve"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    boiler = "This line is held by many documents, and is long enough."
    passage = say(70)
    long = "\n".join(say(30) for _ in range(400))
    rows = [(i, say(rnd.randint(1, 60)) + rnd.choice(["", "\n" + boiler, "\n  " + boiler.upper() + "\t", " " + passage, "\n" + passage])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n\x0b"), (103, "\n\n\n"), (None, say(12) + "\n" + boiler), (None, None), (104, long), (105, long + " end"), (106, "a" * 900)]
    rows += [(7, say(20)), (7, say(25) + "\n" + boiler), rows[0], rows[0], rows[3], (107, passage), (108, "<|endoftext|> 1 2 3 \x1c\x1f   x"), (109, "one two")]
    rows += [(110 + i, f"{passage} {i}") for i in range(6)]
    return rows


def frame(spark, rows, text="text", key="doc_id"):
    df = spark.createDataFrame([(i, t, *[f"{k}-{n}" for n in range(9)]) for k, (i, t) in enumerate(rows)], f"{key} bigint, {text} string, {EXTRA}")
    return df.repartition(3)


def same(df, columns, expected):
    got = Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())
    want = Counter(expected)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


def test_line_dedup(spark, rows):
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    same(line_dedup.line_report(frame(spark, rows)), columns, plain.line_dedup(rows))
    same(line_dedup.line_report(frame(spark, rows), 3, 2), columns, plain.line_dedup(rows, 3, 2))
    assert line_dedup.line_report(frame(spark, [])).count() == 0
    kept = line_dedup.drop_lines(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows)
    same(kept.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)), ["doc_id", kept.select(F.sha2(F.coalesce("text", F.lit("")), 256)).columns[0]], [(r[0], r[3]) for r in plain.line_dedup(rows)])


def test_line_dedup_over_partition_borders(spark):
    line = "a line that stands in a great many of the documents here"
    rows = [(i % 150, line + ("\n" + line) * (i % 3)) for i in range(600)] + [(1000 + i, f"{line} {i % 40}") for i in range(200)]
    same(line_dedup.line_report(frame(spark, rows)), ["doc_id", "n_lines", "n_dropped", "kept_sha256"], plain.line_dedup(rows))


def test_quality(spark, rows):
    more = [(500, "one two three four five six seven eight " * 5), (501, "w " * 30), (502, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 and so on it goes to the end of all words here")]
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality.quality_report(frame(spark, rows + more))
    same(out, columns, plain.quality(rows + more))
    assert out.filter("kept and base_failed").count() == 0
    assert quality.keep_good(frame(spark, rows)).columns == frame(spark, rows).columns
    assert quality.quality_report(frame(spark, [])).count() == 0
    assert not any(n in out._jdf.queryExecution().optimizedPlan().treeString() for n in ("MapInArrow", "PythonUDF", "ArrowEval"))


def test_decontamination(spark, rows):
    items = [(1, rows[-1][1]), (2, "one TWO"), (3, None), (4, ""), (None, "épée ß x1 and"), (6, rows[10][1]), (2, "The of")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    named = [("" if i is None else i, t) for i, t in items]
    want = plain.contamination(rows, named)
    same(decontaminate.contamination_report(frame(spark, rows), bench), columns, want)
    assert decontaminate.contamination_report(frame(spark, []), bench).count() == 0
    same(decontaminate.contamination_report(frame(spark, rows), bench.limit(0)), columns, plain.contamination(rows, []))
    blocks = decontaminate.match_items(frame(spark, rows), bench, max_automaton_words=5)
    same(blocks.select("doc_id", "n_words", F.size("items").cast("bigint").alias("k")), ["doc_id", "n_words", "k"], [(r[0], r[1], r[3]) for r in want])
    clean = decontaminate.remove_spans(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns
    assert clean.count() == sum(not r[5] for r in want)
    in_blocks = decontaminate.remove_spans(frame(spark, rows), bench, max_automaton_words=5)
    assert Counter(in_blocks.collect()) == Counter(clean.collect())
    left = plain.contamination([(r.doc_id, r.text) for r in clean.collect()], named)
    assert sum(r[2] for r in left) <= sum(r[2] for r in want if not r[5]) // 10
    untouched = {t for (_, t), r in zip(rows, want) if r[2] == 0}
    assert untouched <= {r.text for r in clean.collect()}


def test_simhash(spark, rows):
    columns = ["doc_id", "fingerprint", "component_id"]
    same(simhash.simhash_report(frame(spark, rows)), columns, plain.simhash(rows))
    assert simhash.simhash_report(frame(spark, [])).count() == 0
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == plain.simhash_groups(rows)
    nameless = [(None, "one text without an id"), (None, "and quite another text, of other words"), (None, None), (None, "")]
    assert Counter(bool(r.text) for r in simhash.keep_one(frame(spark, nameless)).collect()) == Counter({True: 2, False: 1})


def test_simhash_long_posting_lists(spark):
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    near = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(400)} | {rnd.getrandbits(64) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in near]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for x, a in enumerate(signed):
        for b in signed[:x]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                hi, lo = max(find(a), find(b)), min(find(a), find(b))
                root[hi] = lo
    want = {(f, find(f)) for f in signed if find(f) != f}
    for limit in (2048, 20, 2):
        got = {(r.u, r.root) for r in simhash.components(simhash.links(distinct, limit=limit)).collect()}
        assert got == want, limit


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1000)], "u bigint, v bigint")
    assert {(r.u, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 301)}


def test_repeats(spark, rows):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = plain.repeats(rows)
    same(repeats.repeat_report(frame(spark, rows)), columns, want)
    same(repeats.repeat_report(frame(spark, rows), hot=2), columns, want)
    assert repeats.repeat_report(frame(spark, [])).count() == 0


def test_warc(spark, rows):
    pages = [(i, t) for i, t in rows] + [(900 + i, "<p>" + "same page " * 150) for i in range(5)] + [(902, "<p>" + "same page " * 150), (None, "<p>" + "same page " * 150)]
    df = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i} \r\nq", h, "e") for i, h in pages], "page_id bigint, url string, html string, payload string").repartition(3)
    same(warc.archive_report(df), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], plain.warc(pages))
    assert warc.archive_report(df.limit(0)).count() == 0


def test_items_longer_than_an_automaton_are_cut(spark):
    """A long item's windows are all found, once, whatever parts it is cut into."""
    rnd = random.Random(7)
    words = [f"w{rnd.randrange(30)}" for _ in range(900)]
    items = [(1, " ".join(words)), (2, "one two three"), (3, " ".join(words[100:112]))]
    docs = [(i, " ".join([*words[a : a + n], "zzz", *words[b : b + 40]])) for i, (a, n, b) in enumerate([(0, 13, 500), (20, 12, 860), (895, 5, 0), (300, 200, 301), (887, 13, 40)])] + [(9, "one two three"), (10, None)]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    frame_ = spark.createDataFrame(docs, "doc_id bigint, text string")
    matched = [decontaminate.match_items(frame_, benchmark, max_automaton_words=n) for n in (26, 27, 100, 10_000)]
    rows = [sorted((r.doc_id, r.n_words, bytes(r.hit), tuple(r.items)) for r in m.collect()) for m in matched]
    assert rows[0] == rows[1] == rows[2] == rows[3]
    same(decontaminate.contamination_report(frame_, benchmark), columns, plain.contamination(docs, items))


def test_rows_that_repeat_very_often_share_one_list(spark):
    """5,000 equal rows cost as much a row as two do, and other texts that hold their passages are told from one of them."""
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdef ") for _ in range(3000))
    other = text[:1500] + "".join(rnd.choice("xyz ") for _ in range(400))
    rows = [(1, text)] * 5000 + [(2, other), (3, "z" + text[700:1100] + "q" * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    intervals = repeats.stored(repeats.repeated_intervals(docs), "intervals")
    lists = {r.doc_id: len(r.gone) for r in repeats.with_intervals(docs.dropDuplicates(), intervals).collect()}
    two = spark.createDataFrame(rows[:2] + rows[5000:], "doc_id bigint, text string")
    alike = {r.doc_id: len(r.gone) for r in repeats.with_intervals(two.dropDuplicates(), repeats.repeated_intervals(two)).collect()}
    assert lists[1] <= alike[1] + 2 and lists[1] < 100
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = plain.repeats(rows[:2] + rows[5000:])
    for hot in (repeats.HOT_CORE, 1):
        got = {tuple(r) for r in repeats.repeat_report(docs, hot=hot).select(columns).collect()}
        assert got == set(map(tuple, want))


def test_repeats_by_bytes_in_corpus_order():
    import numpy as np

    rnd = random.Random(1)
    for _ in range(10):
        bases = [bytes(rnd.choice(b"a\0b") for _ in range(500)) for _ in range(3)]
        core, phrases, lead, more = [], [], [], []
        for _ in range(60):
            k = rnd.randrange(3)
            text = bytearray(bases[k])
            for _ in range(rnd.choice([0, 1, 2])):
                at = rnd.randrange(500)
                if not 250 <= at < 311:
                    text[at] = rnd.choice(b"a\0b")
            n = rnd.randint(0, 139)
            m = rnd.randint(0, n)
            core.append(k - 1)
            phrases.append(bytes(text[250 - n : 450 - n + m]))
            lead.append(n)
            more.append(m)
        whose, inside, left, right = repeats.combined(np.array(core), phrases, np.array(lead), np.array(more), 200)
        back = np.array(lead)[whose] - inside
        strings = [(core[k], int(b), phrases[k][i : i + 200]) for k, i, b in zip(whose, inside, back, strict=True)]
        times = Counter(strings)
        assert repeats.equal_to_another(back, left, right).tolist() == [times[s] > 1 for s in strings]
        naive = [(c, s[:b][::-1], s[b:]) for c, b, s in strings]
        for b in set(back.tolist()):
            own = [i for i in range(len(naive)) if back[i] == b]
            assert sorted(own, key=lambda i: (naive[i], i)) == sorted(own, key=lambda i: (left[i], right[i], i))


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 1000])
def test_runs_settle_over_batch_borders(cut):
    import pyarrow as pa

    rnd = random.Random(cut)
    rows = sorted(((rnd.randrange(12) ** 2 // 9, rnd.randrange(3), k if k % 5 else None, k, k << 20, rnd.choice([0, 0, 1])) for k in range(90)), key=lambda r: r[:2])
    kinds = (pa.int64(),) * 5 + (pa.int8(),)
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + cut]), kinds)], names=repeats.RUNS.fieldNames()) for i in range(0, len(rows), cut)]
    got = [tuple(r.values()) for b in repeats._settle(iter(batches)) for r in b.to_pylist()]
    by_phrase = Counter(r[:2] for r in rows)
    settled = {r[:2] for r in rows if r[5]} | {p for p, n in by_phrase.items() if n > 1}
    phrases = Counter(g for g, _ in by_phrase)
    assert Counter(r[1:6] for r in got if r[0] == 0) == Counter(r[:5] for r in rows if not r[5] and by_phrase[r[:2]] > 1)
    assert {(r[1:3], r[6]) for r in got if r[0] == 1} == {(p, int(p in settled)) for p in by_phrase if phrases[p[0]] > 1}
    assert sum(r[0] == 1 for r in got) == sum(n for n in phrases.values() if n > 1)
    assert {(r[1], r[5]) for r in got if r[0] == 2} == {(g, n) for g, n in phrases.items() if n > 1}


def test_tally_drops_pairs_before_they_are_verified():
    import numpy as np

    rnd = np.random.default_rng(5)
    fps = rnd.integers(0, 1 << 63, 300).astype(np.uint64) & ~np.uint64(0xFFFFFF)  # all share positions 0, 1 and 2
    fps[150:] = fps[:150] ^ np.uint64(1 << 40)
    a, b, times = simhash.tally(np.zeros(300, np.int64), fps, (0, 1, 2))
    assert ((fps[a] ^ fps[b]).view(np.uint8).reshape(-1, 8) == 0).sum(1).tolist() == times.tolist()
    kept = times >= 5
    assert kept.sum() >= 150 and (~kept).sum() > 100, "pairs go by the tally alone"
    near = {(i, j) for i in range(300) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert near <= {tuple(sorted(p, reverse=True)) for p in zip(a[kept].tolist(), b[kept].tolist())}


def test_files_of_a_set_size(spark, rows):
    import zlib

    df = frame(spark, rows).coalesce(1)
    out = grammar.ids_report(df, shard_ids=300, file_shards=2).collect()
    want = Counter((i, len(plain.token_ids(t, 2)), zlib.crc32(plain.token_ids(t, 2).tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    pages = [(i, f"<p>{t}" * 3) for i, t in rows]
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in pages], "page_id bigint, url string, html string").coalesce(1)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    same(warc.archive_report(df, file_bytes=2000), columns, plain.warc(pages))


def test_rules_until_no_pair_is_frequent():
    import numpy as np

    ids = np.concatenate([np.tile(np.arange(3, 5), 1 << 20), [2]])  # some twenty rounds of doubling
    for first in (100, 70_000):
        rules, symbols = grammar.compress(ids, first, 2)
        assert (grammar.expand(symbols, grammar.expansions(rules, first)) == ids).all()
        pairs = Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
        assert max(pairs.values()) < grammar.FREQUENT and len(symbols) < 20
        assert (grammar.expansion_lengths(rules, first) >= 2).all()


def test_wide_symbols_on_disk():
    import numpy as np

    docs = [np.array([70_001, 5, 69_999, 5, 69_999, 5, 69_999, 5, 69_999] * 9 + [2]) for _ in range(3)]
    shard = grammar.Shard(memoryview(grammar.write_shard([1, 2, None], docs, 70_010, 2)))
    assert len(shard.rules) and all((shard.ids(k) == d).all() for k, d in enumerate(docs))


def test_names_that_clash_in_any_case(spark):
    df = spark.createDataFrame([(1, "a b c " * 30, "x", "y", "z", 1), (2, None, "x", "y", "z", 2)], "doc_id bigint, text string, _MEASURED string, _Row_Hash string, _drops_ID string, _HIT int")
    bench = spark.createDataFrame([(1, "q r s")], "item_id bigint, text string")
    for out in (quality.keep_good(df), line_dedup.drop_lines(df), simhash.keep_one(df), decontaminate.remove_spans(df, bench)):
        assert out.columns == df.columns
        out.collect()


def test_scratch_folder_is_shared_or_local(spark, monkeypatch):
    from types import SimpleNamespace

    from structscore.llm import common

    conf = SimpleNamespace(get=lambda *_: None)
    away = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        common.shared_dir(away)
    away.sparkContext.getCheckpointDir = lambda: "hdfs://x/y"
    assert common.shared_dir(away) == "hdfs://x/y"
    table = common.stored(spark.range(5).toDF("n"), "gone")
    path = table.inputFiles()[0].removeprefix("file://")
    common.dropped(table)
    assert not Path(path).exists()
    path = common.stored(spark.range(5).toDF("n"), "left").inputFiles()[0].removeprefix("file://")
    common.remove_scratch(spark)
    assert not Path(path).exists()


def test_warc_reader_refuses_damage():
    record = warc.write_record(1, "http://x/", b"hello" * 100, None)
    member = warc._member(record)
    assert [r.payload for r in warc.read_records(member * 3)] == [b"hello" * 100] * 3
    with pytest.raises(ValueError):
        list(warc.read_records(warc._member(record.replace(b"hellohello", b"hellojello", 1))))
    with pytest.raises(ValueError):
        list(warc.read_records(member[:-20]))
    with pytest.raises(ValueError):
        list(warc.read_records(warc._member(record[:-6])))


def test_warc_large_record():
    payload = bytes(range(256)) * (1 << 16)  # 16 MiB: its length needs the fourth byte
    member = warc._member(warc.write_record(5, None, payload, None))
    assert member[-1] != 0
    assert [r.payload == payload for r in warc.read_records(member + warc._member(b""))] == [True]


def test_token_ids(rows):
    import pyarrow as pa

    from structscore.llm.tokens import encoder

    odd = ["", "It's a DOGS' <|endoftext|>x <|startoftext|>", "İstanbul ǅ ŉ ſ K Å é \u0301x a\u00a0b a\x1cb\x85c", "x'S!! 'll ''t 's. t'", "日本語 テスト。 ١٢٣ 12ab ab12, ½", "a\x00b \x0b\x0c c", "ÀÉÎ!? ÀÉÎ, Ünïcödé...", "Ⱥ ȿ ȺȺ, Ⱥ.", None]
    texts = odd + [t for _, t in rows]
    for _ in range(2):  # the second time from the cache
        got = encoder().encode(pa.array(texts).cast(pa.binary()), 1)
        assert [x.tolist() for x in got] == [plain.token_ids(t, 1).tolist() for t in texts]
    assert encoder().encode(pa.array([], pa.binary()), 1) == []
    assert [len(x) for x in encoder().encode(pa.array([b"a\xff b", None]), 1)] == [4, 1]


def unpacked(pieces, length: int):
    """(doc_id, ids) of every document, from pieces in their sequences; all checks on the way."""
    import zlib

    import numpy as np

    pieces = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    place, docs, ids = 0, [], []
    for r in pieces:
        assert r.sequence_id * length + r.offset == place, "no gap, no overlap"
        own = np.frombuffer(r.ids, f"<u{len(r.ids) // r.length}").astype("<u4")
        assert len(own) == r.length and r.offset + r.length <= length
        assert zlib.crc32(own.tobytes()) == r.ids_crc32
        assert r.start == sum(map(len, ids))
        place += r.length
        ids.append(own)
        if r.start + r.length == r.doc_tokens:
            docs.append((r.doc_id, tuple(np.concatenate(ids).tolist())))
            ids = []
    assert not ids
    return docs


def test_packing(spark, rows):
    out = packing.pack(frame(spark, rows), length=64).collect()
    assert Counter(unpacked(out, 64)) == Counter((i, tuple(plain.token_ids(t, 1).tolist())) for i, t in rows)
    short = packing.pack(frame(spark, rows), length=64, with_ids=False)
    assert Counter(short.collect()) == Counter(tuple(r)[:-1] for r in out)
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3)])
def test_neighbours_on_the_curve_are_neighbouring_cells(dimensions, bits):
    import numpy as np

    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = packing.hilbert_index(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_like_documents_are_near_on_the_curve():
    import numpy as np

    rnd = np.random.default_rng(0)
    base = rnd.integers(5, 40_000, 600)
    like = [np.concatenate((base, rnd.integers(5, 40_000, 3))) for _ in range(20)]
    other = [rnd.integers(5, 40_000, 600) for _ in range(200)]
    keys = packing.curve_keys([*like, *other]).astype(float)
    assert np.median(np.abs(keys[:20, None] - keys[:20])) < np.median(np.abs(keys[:20, None] - keys[20:])) / 4


def test_grammar_file(spark, rows):
    import zlib

    out = grammar.ids_report(frame(spark, rows)).collect()
    want = Counter((i, len(plain.token_ids(t, 2)), zlib.crc32(plain.token_ids(t, 2).tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at, last = 0, -1
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else last
    assert grammar.ids_report(frame(spark, [])).count() == 0


def test_grammar_random_access():
    import numpy as np

    rnd = np.random.default_rng(1)
    docs = [np.concatenate((rnd.choice([5, 6, 7, 8], rnd.integers(0, 300)), [2])).astype("<u2") for _ in range(50)]
    data = grammar.write_shard(list(range(50)), docs, 100, 2)
    shard = grammar.Shard(memoryview(data))
    assert len(shard.rules) and len(shard.symbols) < sum(map(len, docs))
    for k, d in enumerate(docs):
        assert (shard.ids(k) == d).all()
        a = int(rnd.integers(0, len(d)))
        assert (shard.ids(k, a, 5) == d[a : a + 5]).all()
    with pytest.raises(ValueError):
        grammar.Shard(memoryview(data[:60] + bytes([data[60] ^ 1]) + data[61:]))


def test_language_model(spark, rows):
    out = language_model.score_texts(frame(spark, rows))
    same(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"], plain.base_scores(rows))
    got = language_model.perplexity(out).collect()
    assert all(r.perplexity < r.base_perplexity for r in got)
    assert language_model.score_texts(frame(spark, [])).count() == 0


def test_language_model_is_a_distribution():
    import numpy as np

    from structscore.llm.seating import Seats, Weights, sweep

    rnd = np.random.default_rng(3)
    count = rnd.integers(0, 9, (40, 25))
    count[:, 0] += 1
    has = np.flatnonzero(count.ravel())
    seats = Seats(count.ravel()[has])
    sweep(seats, Weights(1.0, 0.6, np.full(len(has), 20.0), np.full(len(has), 5.0), np.full(len(has), 100.0)).of, rnd)
    tables = np.zeros(count.size, int)
    tables[has] = seats.tables
    tables = tables.reshape(count.shape)
    root = tables.sum(0)
    root_t = np.where(root > 0, 1, 0)
    x = language_model.Numbers(np.array([count.sum(), (root > 0).sum(), root.sum(), root_t.sum()]), (1.0, 0.6), (2.0, 0.7))
    p0 = np.append(x.root_probability(root, root_t)[root > 0], x.root_probability(np.zeros(1), np.zeros(1)))
    assert abs(p0.sum() - 1) < 1e-9
    above = (x.theta + x.discount * tables.sum(1, keepdims=True)) * x.root_probability(root, root_t)
    p = (count - x.discount * tables + above) / (x.theta + count.sum(1, keepdims=True))
    unknown = (x.theta + x.discount * tables.sum(1)) * p0[-1] / (x.theta + count.sum(1))
    assert np.allclose(p[:, root > 0].sum(1) + unknown, 1)
    assert (tables <= count).all()


def test_language_model_of_long_texts(spark, rows, monkeypatch):
    """Texts longer than a block, many blocks and shards, frequent contexts dealt by dish."""
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 2000)
    out = language_model.score_texts(frame(spark, rows), samples=1, burn_in=0)
    same(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"], plain.base_scores(rows))
    assert all(r.score < 0 for r in out.select("score").collect())


def test_secrets(spark):
    model = secrets.train(secrets.labelled_findings(spark, 3000))
    held = model.transform(secrets.features(secrets.labelled_findings(spark, 1500, 10_000_000)))
    right = held.filter("label = prediction").count() / held.count()
    assert right > 0.98
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    texts = [(1, f'say token = "{key}" here'), (2, f"commit {key}"), (3, "9807915762804490 and some longwordinproseoftext"), (4, None), (5, ""), (None, f'TOKEN = "{key.upper()}"!!'), (1, f'say token = "{key}" here')]
    out = secrets.scan(frame(spark, texts), model).collect()
    assert Counter((r.doc_id, r.candidate.lower()) for r in out if r.is_secret) == Counter({(1, key): 2, (None, key): 1})
    assert {r.candidate for r in out if r.doc_id == 3} == {"9807915762804490", "longwordinproseoftext"}
    assert secrets.scan(frame(spark, []), model).count() == 0
