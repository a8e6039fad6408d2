"""Versions of a keyed table when writers die or meet, and reports kept up to date over several runs."""

from __future__ import annotations

import json
import random

import pytest

from structscore.functions.matching import METRICS
from structscore.plans import report
from structscore.sources import versioned
from structscore.streaming import reports

SCHEMA = "k string, at long, v long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, path)
    first = versioned.upsert(frame([(f"k{i}", 0, i) for i in range(100)] + [("k1", 5, 77)]), path, ["k"], ["at"], 16)
    want = {f"k{i}": (0, i) for i in range(100)} | {"k1": (5, 77)}
    assert rows_of(versioned.read(spark, path)) == sorted(((k, *v) for k, v in want.items()), key=str)
    new = frame([("k3", 1, -3), ("new", 1, 1)])
    second = versioned.upsert(new, path, ["k"], ["at"])
    want |= {"k3": (1, -3), "new": (1, 1)}
    again = versioned.upsert(new, path, ["k"], ["at"])
    assert [first.number, second.number, again.number] == [0, 1, 2]
    assert rows_of(versioned.read(spark, path)) == rows_of(versioned.read(spark, path, 1)) == sorted(((k, *v) for k, v in want.items()), key=str)
    changed = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert 1 <= len(changed) <= 2, "only buckets of changed keys are written"
    assert versioned.upsert(frame([]), path, ["k"], ["at"]).folders == again.folders
    with pytest.raises(ValueError):
        versioned.upsert(new, path, ["at"], ["k"])
    assert versioned.expire(spark, path, keep=1) >= 1
    assert versioned.manifest(spark, path, 0) is None and len(rows_of(versioned.read(spark, path))) == 101


def test_a_writer_that_dies_and_one_that_is_late(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    versioned.upsert(frame([("a", 0, 1), ("b", 0, 2)]), path, ["k"], ["at"], 4)
    started_from = versioned.manifest(spark, path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versioned, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            versioned.upsert(frame([("a", 1, 100)]), path, ["k"], ["at"])
    assert rows_of(versioned.read(spark, path)) == [("a", 0, 1), ("b", 0, 2)], "what has no manifest isn't there"
    late = versioned.write_buckets(spark, path, started_from, frame([("b", 9, 9)]), ["k"], ["at"], 4)
    versioned.upsert(frame([("a", 1, 100)]), path, ["k"], ["at"])
    with pytest.raises(versioned.Conflict):
        versioned._publish(spark, path, late)
    assert rows_of(versioned.read(spark, path)) == [("a", 1, 100), ("b", 0, 2)]
    assert versioned.expire(spark, path) >= 2 and rows_of(versioned.read(spark, path)) == [("a", 1, 100), ("b", 0, 2)]


def test_reports_follow_rows_that_are_judged_again(spark, tmp_path):
    """Three runs with keys judged again, late and unscored rows: equal to a report over the last row of each key."""
    rnd = random.Random(6)
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    last: dict[tuple, dict] = {}
    for run in range(3):
        lines = []
        for i in range(120):
            row = {"model": rnd.choice("mn"), "img_path": f"p{rnd.randrange(40)}", "task": rnd.choice(["SE_MD", "SE_CSV"]), "source_jsonl": "f", "chart_type": rnd.choice(["饼图", "柱状图", None]), "img_type": "x", "lang_type": None}
            row |= {"place": run * 1000 + i - (1500 if i % 10 == 9 else 0)}
            row |= {m: rnd.randrange(8) / 8 if i % 7 else None for m in METRICS}
            lines.append(row)
            key = (row["model"], row["img_path"], row["task"])
            if key not in last or row["place"] >= last[key]["place"]:
                last[key] = row
        lines += [{**lines[0], "model": None}, {**lines[0], "place": None}]
        (tmp_path / "in" / f"{run}.json").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines))
        reports.keep_reports(spark, source, target, checkpoint).awaitTermination()
        rows = spark.createDataFrame([json.dumps(r) for r in last.values()], "string").selectExpr(f"from_json(value, '{reports.ROWS.simpleString()[7:-1].replace(':', ' ')}') AS r").select("r.*")
        scored = report.scored(rows.selectExpr("*", f"struct({', '.join(METRICS)}) AS score"))
        want = report.buckets(scored)
        columns = ["task", *report.DIMENSIONS, "count", "map_high", "em"]
        assert rows_of(reports.current_buckets(spark, target).select(columns)) == rows_of(want.select(columns))
    reports.compact(spark, target, str(tmp_path / "one"))
    assert rows_of(reports.current_buckets(spark, str(tmp_path / "one"))) == rows_of(reports.current_buckets(spark, target))
