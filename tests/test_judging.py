"""Every task through the judge, and its parsers on texts with odd parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from structscore import job
from structscore.functions import activity, json_tables, pies, tables, trees
from structscore.operators import code, walks
from structscore.plans.judging import judge
from structscore.plans.scoring import settled

FLOW = 'flowchart TD\n a["start"] -->|yes| b["end"]'
TABLE = "|  | x | y |\n|---|---|---|\n| r | 1 | 2 |\n| s | 3 | 4 |"

ROWS = [
    ("SE_MERMAID", FLOW, FLOW, 1.0, None),
    ("SE_GRAPHVIZ", 'digraph G { a [label="start"]; b [label="end"]; a -> b [label="yes"]; }', FLOW, 1.0, None),
    ("SE_D2", "a: start\nb: end\na -> b: yes", FLOW, 1.0, None),
    ("SE_D2", FLOW, FLOW, 1.0, None),
    ("SE_CYTOSCAPE", '[{"data": {"id": "a", "label": "start"}}, {"data": {"id": "b", "label": "end"}}, {"data": {"source": "a", "target": "b", "label": "yes"}}]', FLOW, 1.0, None),
    ("SE_DIAGRAMS", 'a = A("start")\nb = A("end")\na >> Edge(label="yes") >> b', FLOW, 1.0, None),
    ("SE_DIAGRAMS", "a = (", FLOW, 0.0, None),
    ("SE_PLANTUML", "@startuml\n:start;\n-> yes;\n:end;\n@enduml", FLOW, 1.0, None),
    ("SE_MD", "- a\n  - b\n  - c", "- a\n  - c\n  - b", 1.0, None),
    ("SE_MD", "- a: b\n  - c\n  - d", "- a\n  - b\n    - c\n    - d", 1.0, None),
    ("SE_MD", FLOW, FLOW, 1.0, None),
    ("SE_MD", TABLE, TABLE, 1.0, None),
    ("SE_JSON", '{"x":{"r":1,"s":3},"y":{"r":2,"s":4}}', TABLE, 1.0, None),
    ("SE_CODE", 'n=["r","s"]\nd={"x":[1,3],"y":[2,4]}', TABLE, 1.0, None),
    ("SE_CSV", ",r,s\nx,1,3\ny,2,4", TABLE, 1.0, None),
    ("SE_JSON", '{"name":"a","children":[{"name":"b"},{"name":"c"}]}', "- a\n  - b\n  - c", 1.0, None),
    ("SE_CSV", "id,parent_id,name\n1,0,a\n2,1,b\n3,1,c", "- a\n  - b\n  - c", 1.0, None),
    ("SE_MD", "flowchart TD\n x[a] --> y[b]\n x --> z[c]", "- a\n  - b\n  - c", 1.0, None),
    ("SE_MD", "a\n\tb\n\tc", "- a\n  - b\n  - c", 1.0, None),
    ("SE_MD", "x | y\na | b\na | c", "- a\n  - b\n  - c", 1.0, None),
    ("SE_MERMAID", "Step | Value\nstart | 12\nending | 3", 'flowchart TD\n a["start"] --> b["ending"]', 1.0, None),
    ("SE_MERMAID", "Step | Value\nstart | now\nending | then", 'flowchart TD\n a["start now"] --> b["ending then"]', 1.0, None),
    ("SE_SVG", "|  | p | q |\n|---|---|---|\n| r | 1 | 2 |\n| s | 3 | 4 |", TABLE, 1.0, None),
    ("SE_SVG", "|  | r | s |\n|---|---|---|\n| x | 1 | 3 |\n| y | 2 | 4 |", TABLE, 0.0, None),
    ("SE_MD", None, TABLE, None, "no_extract"),
    ("SE_MD", "x", "", 0.0, "no_reference"),
    ("OTHER", "x", "y", None, "unknown_task"),
    (None, "x", "y", None, "unknown_task"),
]


def test_every_task(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(ROWS)], "i int, task string, prediction string, reference string")
    got = {r.i: r for r in judge(df).collect()}
    assert len(got) == len(ROWS)
    for i, (task, pred, _, em, error) in enumerate(ROWS):
        assert (got[i].score.em if got[i].score else None) == em, (task, pred)
        assert got[i].error == error


def test_activity(spark):
    chart = "@startuml\ntitle t\nstart\n:a;\nif (ok?) then (yes)\n  :b;\nelseif (maybe?) then (hm)\n  :c;\nelse (no)\n  back to :a;\nendif\nnote right\n:x;\nend note\n:d;\nstop\n@enduml"
    df = settled(spark.createDataFrame([(chart,), ("",), (None,)], "t string"), {"e": activity.events(F.col("t"))})
    g = [r[0] for r in df.select(activity.plantuml(F.col("e"))).collect()]
    assert [n.id for n in g[0].nodes] == ["t", "a", "ok?", "b", "maybe?", "c", "d"]
    assert {(e.src, e.dst, e.label) for e in g[0].edges} == {
        ("t", "a", ""), ("a", "ok?", ""), ("ok?", "b", "yes"), ("ok?", "maybe?", ""), ("maybe?", "c", "hm"), ("maybe?", "a", "no"), ("b", "d", ""), ("c", "d", ""),
    }
    assert g[1].nodes == g[2].nodes == []


def test_json_tables(spark):
    said = {
        '{"values":{"O":{"r":{"min":0,"mid":7},"q":{"min":1}}}}': [["", "O-min", "O-mid"], ["r", "0", "7"], ["q", "1", ""]],
        '{"A":{"x":1,"y":"b"},"B":{"x":3}}': [["", "A", "B"], ["x", "1", "3"], ["y", "b", ""]],
        '```json\n{"a": 1, "b": "z"}\n```': [["key", "value"], ["a", "1"], ["b", "z"]],
        "nope": [],
        '{"A": {"x"': [],
    }
    df = settled(spark.createDataFrame([(t,) for t in said], "t string"), {"v": json_tables.values(F.col("t"))})
    assert {r.t: r.x for r in df.select("t", json_tables.json_table(F.col("v")).alias("x")).collect()} == said


def test_code():
    assert code.table_of('import x\nx = ["a","b"]\ny=[1,2.5]\nplt.bar(x,y,label="n")') == [["", "n"], ["a", "1"], ["b", "2.5"]]
    assert code.table_of('d={"k":["p","q"],"v":[1,2]}') == [["k", "v"], ["p", "1"], ["q", "2"]]
    assert code.table_of("x = [") == code.table_of(None) == code.table_of("open('x')") == []
    assert code.diagram_of("x = [") == {"nodes": [], "edges": []}


def test_pies(spark):
    whole = [["", ""], ["a", "28%"], ["b", "16%"], ["c", "56%"]]
    said = {
        'pie title x\n"a" : 28\n"b" : 16\n"c" : 56': whole,
        "| x | y |\n|---|---|\n| a 28% | b(16%) |\n| c, 56% |  |": whole,
        "| x | y |\n|---|---|\n| a 28% | 1 |\n| b 16% | 2 |": [["", "", "y"], ["a", "28%", "1"], ["b", "16%", "2"]],
        "| x | y |\n|---|---|\n| a | 28% |": [["x", "y"], ["a", "28%"]],
        'pie\n"a" : 28': [],
    }
    df = settled(spark.createDataFrame([(t,) for t in said], "t string"), {"rows": tables.any_table(F.col("t"))})
    assert {r.t: r.x for r in df.select("t", pies.pie_rows(F.col("t"), F.col("rows")).alias("x")).collect()} == said
    assert [r[0] for r in spark.createDataFrame([("饼图",), ("Pie",), ("柱状图",), (None,)], "c string").select(pies.is_pie(F.col("c"))).collect()] == [True, True, False, False]


def test_loose_limits_hold_for_every_form(spark, tmp_path):
    flow = 'flowchart TD\n a["start of it"] --> b["the end"]'
    said = 'flowchart TD\n a["start of that"] --> b["the ends"]'
    spark.createDataFrame([(t, said, flow) for t in ("SE_MERMAID", "SE_MD")], "task string, prediction string, reference string").write.parquet(str(tmp_path / "t"))
    judged = judge(spark.read.parquet(str(tmp_path / "t")), loose=True)
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1, "the source is read once"
    scores = {r.score for r in judged.select("score").collect()}
    assert len(scores) == 1 and scores.pop().map_slight > 0.5, "a flow chart under a table task has the loose limits, too"


def test_outline_forms(spark):
    said = {
        "项目 | 数值\n客户探索 | 争取支持\n客户探索 | 提出假设\n效验 | 明确 | 12 | z": [(0, "客户探索"), (1, "争取支持"), (1, "提出假设"), (0, "效验"), (0, "明确"), (0, "z")],
        "Root\na | 1\n  b | c\n  b2 | 3%": [(0, "Root"), (0, "a"), (1, "b"), (1, "c"), (1, "b2")],
        "no pipes\nhere": [],
        "": [],
        None: [],
    }
    told = lambda f, t: [(e.level, e.name) for e in spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("e")).first().e]
    for text, entries in said.items():
        assert told(trees.pipe_entries, text) == entries, text
    assert told(trees.text_entries, "a\n  b\n    1. c\n---\n  * d\n<x>\n一、e") == [(0, "a"), (1, "b"), (2, "c"), (1, "d"), (0, "e")]
    assert told(trees.adjacency_entries, "id,parent_id,name\n1,0,A\n2,1,B\n3,2,C\n4,1,D\n5,9,E\n6,7,x\n7,6,y") == [(0, "A"), (1, "B"), (2, "C"), (1, "D"), (0, "E")]
    assert told(trees.adjacency_entries, "1,,A\n3,2,C\n2,1,B\n4,1,D") == [(0, "A"), (1, "B"), (2, "C"), (1, "D")]
    assert told(trees.adjacency_entries, "") == []


def test_walks():
    deep = "{\"name\": \"x\", \"children\": [" * 200 + "]}" * 200
    assert [e["level"] for e in walks.json_entries(deep)] == list(range(200))
    assert walks.json_entries('{"k": {"l": "v"}, "m": [1, null]}') == [{"level": i, "name": n} for i, n in ((0, "k"), (1, "l"), (2, "v"), (0, "m"), (1, "1"))]
    assert walks.json_entries("nope") == walks.json_entries(None) == walks.graph_entries(None) == []
    ring = {"nodes": [{"id": i, "label": i.upper()} for i in "abc"], "edges": [{"src": s, "dst": d} for s, d in ("ab", "bc", "ca")]}
    assert [(e["level"], e["name"]) for e in walks.graph_entries(ring)] == [(0, "A"), (1, "B"), (2, "C")]


def test_job(spark, tmp_path):
    rows = [(str(i), "m", t, p, r) for i, (t, p, r, _, _) in enumerate(ROWS)]
    spark.createDataFrame(rows, "img_path string, model string, task string, prediction string, reference string").write.parquet(str(tmp_path / "in"))
    o = job.options([str(tmp_path / "in"), str(tmp_path / "out"), "--tasks", "SE_MD", "--skip-missing", "--model", "/models/name/"])
    folder = job.run(spark, o)
    assert folder.endswith("/out/name")
    assert spark.read.parquet(f"{folder}/judged").count() == sum(t == "SE_MD" and p is not None for t, p, *_ in ROWS)
    assert spark.read.parquet(f"{folder}/overview").columns[0] == "model"
    assert job.tag(job.options(["a", "b"])) == "default"
