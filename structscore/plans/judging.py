"""Scores for every task: each row by the form that its task and reference ask for.

A row is scored as a graph if its task is one or its reference is a flow chart,
as a tree if its reference is an outline, else as a table.  All rows go through
one chain of columns, each filled where a row needs it: the source is read once.
Where a first reading scores low, the row is read another way as its form allows
(a table turned, a list of nodes by rows, an outline from a pipe table), and the
better score stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import activity, answers, graphs, json_tables, matching, pies, tables, trees
from ..functions.text import let, strip, strip_fence
from ..operators.assignment import graph_similarity, tree_similarity
from ..operators.code import code_edges, code_graph, code_table
from ..operators.walks import graph_levels, json_levels
from .resume import judgement_error
from .scoring import settled, with_scores, with_triples

NEEDED = ["task", "prediction", "reference"]
KNOWN = [*answers.TABLE_TASKS, "SE_MD_w_HINT", *answers.GRAPH_TASKS]

#: Below this map_high a row is read another way as well.
WEAK = 0.5


def _side(g: Column) -> Column:
    """What a graph is compared by."""
    return F.when(g.isNotNull(), F.struct(F.transform(g["nodes"], lambda n: n["label"]).alias("nodes"), graphs.labelled_edges(g).alias("edges")))


def _scores(sims: Column) -> Column:
    return F.when(sims.isNotNull(), matching.scores({n: sims[n] for n in matching.TOLERANCES}))


def _better(first: Column, other: Column) -> Column:
    return F.when(other["map_high"] > first["map_high"], other).otherwise(first)


def _form(task: Column, text: Column, branch: Column) -> Column:
    """How the prediction of a graph or tree row is read."""
    graph = F.when((task == "SE_CODE") & ~graphs.is_mermaid(text), "code").when(~task.isin(answers.GRAPH_TASKS) | graphs.is_mermaid(text), "mermaid").when(task == "SE_MERMAID", "listed").otherwise(task)
    tree = (
        F.when(task == "SE_JSON", "json")
        .when(task == "SE_CSV", "adjacency")
        .when((task == "SE_CODE") & ~trees.is_outline(text), "code")
        .when(task.isin("SE_CODE", "SE_SVG") | trees.is_outline(text), "list")
        .when(graphs.is_mermaid(text), "walk")
        .otherwise("lines")
    )
    return F.when(branch == "graph", graph).when(branch == "tree", tree)


def _read(df: DataFrame) -> DataFrame:
    """Columns of what predictions and references are read as, from _branch and chart."""
    text, form, branch, task = F.col("_t"), F.col("_form"), F.col("_branch"), F.col("task")
    df = settled(df, {"_t": strip(F.coalesce("prediction", F.lit("")))})
    df = settled(df, {"_form": _form(task, text, branch)})
    table = branch == "table"
    df = settled(
        df,
        {
            "_events": F.when(form == "SE_PLANTUML", activity.events(text)),
            "_mermaid": F.when(form.isin("mermaid", "walk", "code"), graphs.mermaid(text)),
            "_values": F.when(table & (task == "SE_JSON"), json_tables.values(text)),
            "_given": F.when(table, F.when(task.isin("SE_CSV", "SE_JSON"), strip_fence(text)).otherwise(text)),
        },
    )
    # the helpers that are no expressions; rows without need have null there
    df = df.withColumns(
        {
            "_diagram": code_graph(F.when(form == "SE_DIAGRAMS", text)),
            "_code": code_table(F.when(table & (task == "SE_CODE"), text)),
            "_json": json_levels(F.when(form == "json", strip_fence(text))),
            "_edges": code_edges(F.when(form == "code", text)),
        }
    )
    walked = F.when(form == "walk", F.col("_mermaid")).when((form == "code") & (branch == "tree"), F.col("_edges"))
    df = df.withColumns({"_walk": graph_levels(walked)})
    graph = (
        F.when(form == "mermaid", F.col("_mermaid"))
        .when(form == "code", F.when(F.size("_edges.edges") > 0, F.col("_edges")).otherwise(F.col("_mermaid")))
        .when(form == "listed", F.coalesce(graphs.in_a_row(graphs.listed_nodes(text)), graphs.mermaid(text)))
        .when(form == "SE_GRAPHVIZ", graphs.dot(text))
        .when(form == "SE_PLANTUML", activity.plantuml(F.col("_events")))
        .when(form == "SE_DIAGRAMS", F.col("_diagram"))
        .when(form == "SE_D2", graphs.d2(text))
        .when(form == "SE_CYTOSCAPE", graphs.cytoscape(text))
    )

    def else_list(entries: Column, least: int) -> Column:
        return let(entries, lambda e: F.when(F.size(e) >= least, e).otherwise(trees.list_entries(text)))

    entries = (
        F.when(form == "json", else_list(F.col("_json"), 1))
        .when(form == "adjacency", else_list(trees.adjacency_entries(text), 1))
        .when(form == "walk", F.col("_walk"))
        .when(form == "code", else_list(F.col("_walk"), 1))
        .when(form == "lines", else_list(trees.text_entries(text), 2))
        .when(form == "list", trees.list_entries(text))
    )
    none = F.array().cast("array<array<string>>")
    rows = F.when(~table, none).when((task == "SE_CODE") & (F.size("_code") > 0), F.col("_code"))
    rows = rows.when((task == "SE_JSON") & (F.col("_values") != ""), json_tables.json_table(F.col("_values"))).otherwise(F.get("_read", F.lit(0)))
    reference = F.when(~table, none).otherwise(F.get("_read", F.lit(1)))
    df = settled(df, {"_read": F.when(table, F.transform(F.array("_given", "reference"), tables.any_table))})
    df = settled(
        df,
        {
            "_pg": graph,
            "_rg": F.when(branch == "graph", graphs.mermaid(F.col("reference"))),
            "_pe": entries,
            "_re": F.when(branch == "tree", trees.list_entries(F.col("reference"))),
            "pred_rows": rows,
            "ref_rows": reference,
        },
    )
    return settled(
        df,
        {
            # a pie may be told in other forms; drawings have no column names
            "pred_rows": F.when(table & pies.is_pie(F.col("_chart")), pies.pie_rows(text, F.col("pred_rows"))).otherwise(F.col("pred_rows")),
            "ref_rows": F.when((task == "SE_SVG") & (F.size("ref_rows") > 0) & ~tables.headless(F.col("ref_rows")), tables.blank_header(F.col("ref_rows"))).otherwise(F.col("ref_rows")),
        },
    )


def _with_paths(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Merged paths of outlines, from columns of entries."""
    df = settled(df, {f"{p}_n": F.when(F.col(e).isNotNull(), trees.nested(F.col(e))) for p, e in paths.items()})
    df = settled(df, {f"{p}_c": F.when(F.col(f"{p}_n").isNotNull(), trees.child_counts(F.col(f"{p}_n"))) for p in paths})
    return settled(df, {p: F.when(F.col(f"{p}_n").isNotNull(), trees.merged_paths(F.col(f"{p}_n"), F.col(f"{p}_c"))) for p in paths})


def _with_structures(df: DataFrame, loose: bool) -> DataFrame:
    """`_structure`: the score of graph and tree rows."""
    df = _with_paths(settled(df, {"_a": _side(F.col("_pg")), "_b": _side(F.col("_rg"))}), {"_pp": "_pe", "_rp": "_re"})
    df = df.withColumns({"_gs": graph_similarity(F.col("_a"), F.col("_b"), loose), "_ts": tree_similarity(F.col("_pp"), F.col("_rp"), loose)})
    df = settled(df, {"_one": F.coalesce(_scores(F.col("_gs")), _scores(F.col("_ts")))})
    weak = F.col("_one.map_high") < WEAK
    pipe = F.when(weak & (F.col("_branch") == "tree") & F.contains(F.col("_t"), F.lit("|")), trees.pipe_rows(F.col("_t")))
    by_row = F.when(weak & (F.col("_form") == "listed"), graphs.listed_nodes(F.col("_t"), "row"))
    # step by step: nested, these expressions take many times as long to plan
    df = settled(df, {"_listed2": by_row, "_pipe": pipe})
    df = settled(df, {"_row": graphs.in_a_row(F.col("_listed2")), "_parents": trees.pipe_parents(F.col("_pipe"))})
    df = settled(df, {"_a2": _side(F.col("_row")), "_levels": trees.pipe_levels(F.col("_pipe"), F.col("_parents"))})
    df = settled(df, {"_pe2": F.when(F.col("_pipe").isNotNull(), trees.named_once(F.col("_pipe"), F.col("_levels")))})
    df = _with_paths(settled(df, {"_pe2": F.when(F.size("_pe2") >= 2, F.col("_pe2"))}), {"_pp2": "_pe2"})
    df = df.withColumns(
        {
            "_gs2": graph_similarity(F.col("_a2"), F.when(F.col("_a2").isNotNull(), F.col("_b")), loose),
            "_ts2": tree_similarity(F.col("_pp2"), F.when(F.col("_pp2").isNotNull(), F.col("_rp")), loose),
        }
    )
    return settled(df, {"_structure": _better(F.col("_one"), F.coalesce(_scores(F.col("_gs2")), _scores(F.col("_ts2"))))})


def _with_tables(df: DataFrame, loose: bool) -> DataFrame:
    """`_table`: the score of table rows; a weak one is tried turned, but for drawings."""
    first = with_scores(with_triples(df), loose).drop("pred", "ref", "sim_strict", "sim_slight", "sim_high").withColumnRenamed("score", "_first")
    weak = (F.col("_branch") == "table") & (F.col("_first.map_high") < WEAK) & (F.col("task") != "SE_SVG")
    none = F.array().cast("array<array<string>>")
    turned = settled(first, {"pred_rows": F.when(weak, tables.transpose(F.col("pred_rows"))).otherwise(none), "ref_rows": F.when(weak, F.col("ref_rows")).otherwise(none)})
    again = with_scores(with_triples(turned), loose)
    return settled(again, {"_table": F.when(weak, _better(F.col("_first"), F.col("score"))).otherwise(F.col("_first"))})


def score_graphs(df: DataFrame, loose: bool = False) -> DataFrame:
    """Predictions in six notations against Mermaid references."""
    tagged = df.withColumns({"_branch": F.lit("graph"), "_chart": F.lit(None).cast("string")})
    return _with_structures(_read(tagged), loose).select(*df.columns, F.col("_structure").alias("score"))


def judge(rows: DataFrame, loose: bool = False) -> DataFrame:
    """`rows` (with task, prediction, reference, perhaps chart_type) plus score and error.

    Unknown tasks and missing predictions have an error and no score, so that
    reports leave them out.  An empty reference has an error and scores 0, so
    that reports count it.
    """
    error = judgement_error(F.lit(True), F.col("prediction"), F.coalesce(F.col("task").isin(KNOWN), F.lit(False)), F.col("reference"))
    tagged = settled(
        rows,
        {
            "error": error,
            "_chart": F.col("chart_type").cast("string") if "chart_type" in rows.columns else F.lit(None).cast("string"),
            "_branch": F.when(error.isNotNull(), "none")
            .when(F.col("task").isin(answers.GRAPH_TASKS), "graph")
            .when(trees.is_outline(F.col("reference")), "tree")
            .when(graphs.is_mermaid(F.col("reference")), "graph")
            .otherwise("table"),
        },
    )
    made = _with_tables(_with_structures(_read(tagged), loose), loose)
    score = F.when(F.col("_branch").isin("graph", "tree"), F.col("_structure")).when(F.col("_branch") == "table", F.col("_table"))
    score = score.when(F.col("error") == "no_reference", matching.zero_scores())
    return made.select(*rows.columns, score.alias("score"), "error")


def read_graphs(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `notation` and `graph` of texts that come without a task: what a text looks like says how it is read.

    Both are null where a text is in no notation; `graph` is empty where its
    notation's parser finds nothing.
    """
    df = settled(df, {"notation": graphs.notation(F.col(text))})
    of = lambda kind: F.col("notation") == kind
    df = settled(df, {"_events": F.when(of("plantuml"), activity.events(F.col(text)))}).withColumn("_diagram", code_graph(F.when(of("diagrams"), F.col(text))))
    graph = F.when(of("plantuml"), activity.plantuml(F.col("_events"))).when(of("diagrams"), F.col("_diagram"))
    for kind, parse in graphs.PARSERS.items():
        graph = graph.when(of(kind), parse(F.col(text)))
    return settled(df, {"graph": graph}).drop("_events", "_diagram")
