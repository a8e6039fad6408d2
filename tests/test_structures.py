"""Trees, graphs, pairings, reports, resuming, sources and streams."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from structscore import catalog, schema
from structscore.functions import answers, graphs, trees
from structscore.operators import assignment
from structscore.plans import report, resume, scoring
from structscore.sources import answering, images, jsonl
from structscore.streaming import incremental


def test_outline_and_merge(spark):
    t = "- A\n  - B\n    - C\n    - D\n\nnot a line\n- E: F\n\t- G\n\t- H"
    df = scoring.settled(spark.createDataFrame([(t,), ("",), (None,)], "t string"), {"n": trees.outline(F.col("t"))})
    df = scoring.settled(df, {"c": trees.child_counts(F.col("n"))})
    rows = df.select(trees.paths(F.col("n")).alias("p"), trees.merged_paths(F.col("n"), F.col("c")).alias("m")).collect()
    assert rows[0].p == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "B", "D"], ["E: F"], ["E: F", "G"], ["E: F", "H"]]
    assert rows[0].m == [["A——B"], ["A——B", "C"], ["A——B", "D"], ["E——F"], ["E——F", "G"], ["E——F", "H"]]
    assert rows[1].p == rows[2].p == []


def test_empty_trees(spark):
    df = spark.createDataFrame([([], []), ([["a"]], []), ([["a"], ["b"]], [["b"], ["a"]])], "a array<array<string>>, b array<array<string>>")
    assert [r[0].strict for r in df.select(assignment.tree_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


CHART = {
    "mermaid": 'flowchart TD\n  A["start"] --> B{"ok?"}\n  B -->|yes| C(go on)\n  B -- no --> A\n  C --> D --> E\n  %% note\n  style A fill:#fff',
    "graphviz": 'digraph G {\n rankdir=LR; node [shape=box];\n A [label="start"]; B [label="ok?", shape=diamond];\n C [label="go on"];\n A -> B;\n B -> C [label="yes"];\n B -> A [label="no"]; // back\n C -> D -> E;\n}',
    "d2": "A: start\nB: ok?\nC: go on\nA -> B\nB -> C: yes\nB -> A: no\nC -> D -> E",
    "cytoscape": json.dumps(
        {
            "elements": {
                "nodes": [{"data": {"id": i, "label": n}} for i, n in (("A", "start"), ("B", "ok?"), ("C", "go on"), ("D", "D"), ("E", "E"))],
                "edges": [{"data": {"source": s, "target": t, "label": n}} for s, t, n in (("A", "B", ""), ("B", "C", "yes"), ("B", "A", "no"), ("C", "D", ""), ("D", "E", ""))],
            }
        }
    ),
}


@pytest.mark.parametrize("name", CHART)
def test_notations_give_one_graph(spark, name):
    for said in (CHART[name], f"```{name}\n{CHART[name]}\n```"):
        g = spark.createDataFrame([(said,)], "t string").select(graphs.PARSERS[name](F.col("t"))).first()[0]
        assert {(n.id, n.label) for n in g.nodes} == {("A", "start"), ("B", "ok?"), ("C", "go on"), ("D", "D"), ("E", "E")}
        assert sorted((e.src, e.dst, e.label) for e in g.edges) == [("A", "B", ""), ("B", "A", "no"), ("B", "C", "yes"), ("C", "D", ""), ("D", "E", "")]


def test_pairing_is_the_best():
    rnd = random.Random(1)
    for _ in range(200):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        cost = np.array([[rnd.choice([0, 0.25, 0.5, rnd.random()]) for _ in range(m)] for _ in range(n)])
        pairs = assignment.assign(cost)
        orders = itertools.permutations(range(max(n, m)), min(n, m))
        best = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in enumerate(p)) for p in orders)
        assert len(pairs) == min(n, m) and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9
    assert assignment.ratio("", "") == 1.0 and assignment.ratio("a", "") == 0.0 and assignment.ratio("abc", "abd") == pytest.approx(2 / 3)


def test_extracts(spark):
    said = {
        ("SE_MD", " | a | \n"): "| a |",
        ("SE_MD", "  "): None,
        ("SE_CODE", "x\n```python\nprint(1)\n```\ny"): "print(1)",
        ("SE_SVG", "see <svg a='1'><text>x</text></svg> end"): "<svg a='1'><text>x</text></svg>",
        ("SE_SVG", "none"): None,
        ("SE_MERMAID", "```mermaid\nflowchart TD\nA --> B\n```"): "flowchart TD\nA --> B",
        ("SE_PLANTUML", "so:\n@startuml\n:a;\n@enduml bye"): "@startuml\n:a;\n@enduml",
        ("SE_OTHER", "x"): None,
    }
    df = spark.createDataFrame([(t, a) for t, a in said], "task string, a string")
    assert {(r.task, r.a): r.x for r in df.select("task", "a", answers.extracted(F.col("a"), F.col("task")).alias("x")).collect()} == said


def test_failed_rows_are_left_out_and_means_are_micro(spark):
    score = lambda v: None if v is None else {m: v for m in report.METRICS}
    rows = [("m", "f", "t", "c", None, "en", score(v)) for v in (1.0, 0.0, None)] + [("m", "g", "t", "c", "i", "en", score(0.5))] * 3
    kind = f"model string, source_jsonl string, task string, chart_type string, img_type string, lang_type string, score {schema.SCORE.simpleString()}"
    sums = report.buckets(report.scored(spark.createDataFrame(rows, kind)))
    one = report.means(sums, ["model"]).first()
    assert (one.em, one["count"]) == (0.5, 5)
    sheet = report.task_sheet(sums, "t", ["f", "g", "h"]).first()
    assert (sheet.f_em, sheet.g_em, sheet.h_em) == (0.5, 0.5, 0.0)
    assert {r.img_type for r in sums.collect()} == {"未知", "i"}


def test_resume_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = resume.upserted(old, new, ["k"])
    assert sorted(once.collect()) == sorted(resume.upserted(once, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert resume.not_done(once, new, ["k"]).collect() == [(1, "a")]


def test_json_lines(spark, tmp_path):
    for model, names in (("m1", ["a", "b"]), ("_x", ["a"]), (".h", ["a"])):
        (tmp_path / model).mkdir()
        for n in names:
            (tmp_path / model / f"{n}.jsonl").write_text(json.dumps({"img_path": f"{n}.png", "img_type": "电子印刷"}) + "\n\n{broken\n")
    rows = jsonl.models(spark, str(tmp_path), schema.SAMPLE, jsonl.SCENES).select("model", "source_jsonl", "img_path", "img_type").collect()
    assert sorted(rows) == [("m1", "a", "a.png", "打印"), ("m1", "b", "b.png", "打印")]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        jsonl.strict(spark, f"{tmp_path}/m1", schema.SAMPLE).collect()
    version = jsonl.rewrite(None, spark.createDataFrame([("m", 1)], "model string, v int"), ["model"], str(tmp_path / "out"), ["model"])
    assert spark.read.parquet(version).count() == 1


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504e470d0a1a0a") + b"x")
    files = images.images(spark, str(tmp_path))
    assert files.select(images.data_uri(F.col("content"))).first()[0].startswith("data:image/png;base64,iVBORw0KGgp4")
    samples = spark.createDataFrame([(f"{tmp_path}/a.png",), (f"{tmp_path}/b.png",)], "img_path string")
    assert images.existing(samples, files).count() == 1


def test_answering(spark):
    def factory():
        seen = {}

        def client(prompt: str, image: str) -> str:
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "bad" or (prompt == "late" and seen[prompt] < 2):
                raise OSError("no")
            return f"<think>\nhm\n</think>\n<answer>\n| {prompt} |\n</answer>"

        return client

    rows = spark.createDataFrame([("SE_MD", p, "") for p in ("good", "late", "bad")], "task string, prompt string, image string")
    got = {r.prompt: (r.thinking, r.extract, r.error) for r in answering.with_extracts(answering.ask(rows, factory, wait=0.0)).collect()}
    assert got == {"good": ("hm", "| good |", None), "late": ("hm", "| late |", None), "bad": ("", None, "OSError: no")}


def test_stream(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    (tmp_path / "in").mkdir()
    row = lambda p, v: json.dumps({"model": "m", "img_path": p, "task": "SE_MD", "prediction": f"| k | v |\n|--|--|\n| a | {v} |", "reference": "| k | v |\n|--|--|\n| a | 1 |"})
    (tmp_path / "in" / "1.json").write_text(row("p", 9) + "\n" + row("q", 1) + "\n")
    incremental.judge_stream(spark, source, target, marks).awaitTermination()
    (tmp_path / "in" / "2.json").write_text(row("p", 1) + "\n")
    incremental.judge_stream(spark, source, target, marks).awaitTermination()
    rows = {r.img_path: (r.score.em, r.batch) for r in incremental.current(spark, target).collect()}
    assert rows == {"p": (1.0, 1), "q": (1.0, 0)}


def test_every_query_has_sql_with_its_columns(spark):
    assert set(catalog.queries()) == set(catalog.oracle_sql())
