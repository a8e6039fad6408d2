"""What a model's answer holds: the fenced or bare piece that each task asks for.

Every extractor gives a non-empty string or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fenced, let, strip

# Tasks and the kinds of chart they apply to.
TABLE_TASKS = ["SE_MD", "SE_JSON", "SE_CSV", "SE_CODE", "SE_SVG"]
GRAPH_TASKS = ["SE_MERMAID", "SE_GRAPHVIZ", "SE_PLANTUML", "SE_DIAGRAMS", "SE_D2", "SE_CYTOSCAPE"]
FLOW_CHART, MIND_MAP = "流程图", "思维导图"


def thinking_and_answer(response: Column) -> Column:
    """struct<thinking, answer> of a reply in think and answer tags; others are all answer."""
    pattern = "(?s)<think>\\n(.*?)\\n</think>\\n<answer>\\n(.*?)\\n</answer>"
    has = response.rlike(pattern)
    return F.struct(
        F.when(has, F.regexp_extract(response, pattern, 1)).otherwise("").alias("thinking"),
        F.when(has, F.regexp_extract(response, pattern, 2)).otherwise(response).alias("answer"),
    )


def _given(text: Column) -> Column:
    return F.nullif(strip(F.coalesce(text, F.lit(""))), F.lit(""))


def _from(answer: Column, languages: str, bare: str) -> Column:
    """The last block in one of the languages, else any last block that looks right, else the bare match."""
    found = F.regexp_extract_all(answer, F.lit(bare), F.lit(0))
    any_block = fenced(answer, "[A-Za-z0-9_\\-]*")
    return F.coalesce(
        _given(fenced(answer, languages)),
        F.when(any_block.rlike(bare), _given(any_block)),
        F.when(F.size(found) > 0, _given(F.element_at(found, -1))),
    )


def extracted(answer: Column, task: Column) -> Column:
    """The piece of `answer` for `task`; null where there is none or the task is unknown."""

    def by_task(a: Column) -> Column:
        code = F.coalesce(_given(fenced(a, "python|py")), _given(fenced(a, "[A-Za-z0-9_\\-]*")), _given(a))
        return (
            F.when(task.isin("SE_MD", "SE_MD_w_HINT", "SE_JSON", "SE_CSV"), _given(a))
            .when(task.isin("SE_CODE", "SE_DIAGRAMS"), code)
            .when(task == "SE_SVG", _from(a, "svg|xml|html", "(?is)<svg\\b.*?</svg>"))
            .when(task == "SE_MERMAID", _from(a, "mermaid", "(?ims)^\\s*(?:flowchart|graph)\\s+.*"))
            .when(task == "SE_GRAPHVIZ", _from(a, "dot|graphviz|gv", "(?is)\\b(?:strict\\s+)?(?:di)?graph\\b[^{]*\\{.*?\\}"))
            .when(task == "SE_PLANTUML", _from(a, "plantuml|puml|uml", "(?is)@startuml.*?@enduml"))
            .when(task == "SE_D2", _from(a, "d2", "(?s)^.*->.*$"))
            .when(task == "SE_CYTOSCAPE", _from(a, "json|cytoscape", "(?s)\\{.*\\}"))
        )

    return let(F.coalesce(answer, F.lit("")), by_task)


def category(chart_type: Column) -> Column:
    """flowchart, logic or data; unknown and missing types are data."""
    return F.when(chart_type == FLOW_CHART, "flowchart").when(chart_type == MIND_MAP, "logic").otherwise("data")


def tasks_of(chart_type: Column, data: list[str], logic: list[str], flowchart: list[str]) -> Column:
    """The tasks that a sample is asked."""
    listed = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    return F.when(chart_type == FLOW_CHART, listed(flowchart)).when(chart_type == MIND_MAP, listed(logic)).otherwise(listed(data))


def applicable(tasks: Column, chart_type: Column) -> Column:
    """Flow charts keep graph tasks alone; others drop them."""
    graph = F.array(*map(F.lit, GRAPH_TASKS))
    flow = F.coalesce(chart_type == FLOW_CHART, F.lit(False))
    return F.filter(tasks, lambda t: F.array_contains(graph, t) == flow)


def prediction(extract: Column, raw: Column) -> Column:
    """The extracted text of a result whose extract is a struct as JSON or a bare string."""
    return F.coalesce(F.get_json_object(extract, "$.extracted_table"), F.when(~strip(extract).startswith("{"), extract), raw, F.lit(""))


def pending(required: Column, done: Column) -> Column:
    """Tasks of `required` that the map `done` doesn't have."""
    return F.array_except(required, F.coalesce(F.map_keys(done), F.array().cast("array<string>")))
