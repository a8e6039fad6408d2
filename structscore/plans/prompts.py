"""What a sample is asked: a small table of tasks, categories and texts, joined to samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers

# Which tasks a category is asked, as its tables, outlines and flow charts allow.
CATEGORY_TASKS = {"data": [*answers.TABLE_TASKS], "logic": [*answers.TABLE_TASKS], "flowchart": [*answers.GRAPH_TASKS]}

FORMS = {
    "SE_MD": {"data": "a Markdown table", "logic": "a nested Markdown list"},
    "SE_JSON": {"data": "JSON, an object per category", "logic": "JSON, objects of name and children"},
    "SE_CSV": {"data": "comma-separated lines with a header", "logic": "comma-separated lines id, parent_id, name"},
    "SE_CODE": {"data": "Python that holds the data in literals", "logic": "Python that builds the tree"},
    "SE_SVG": {"data": "an SVG drawing", "logic": "an SVG drawing"},
    "SE_MERMAID": {"flowchart": "a Mermaid flow chart"},
    "SE_GRAPHVIZ": {"flowchart": "a Graphviz graph"},
    "SE_PLANTUML": {"flowchart": "a PlantUML activity chart"},
    "SE_DIAGRAMS": {"flowchart": "Python in the diagrams notation"},
    "SE_D2": {"flowchart": "a D2 diagram"},
    "SE_CYTOSCAPE": {"flowchart": "Cytoscape JSON"},
}


def prompts(spark: SparkSession) -> DataFrame:
    """(task, category, prompt) for every pair that is possible."""
    said = [(t, c, f"Write what the chart shows as {FORMS[t][c]}, and nothing else.") for c, own in CATEGORY_TASKS.items() for t in own]
    return spark.createDataFrame(said, "task string, category string, prompt string")


def asked(samples: DataFrame, tasks: list[str]) -> DataFrame:
    """`samples` (with chart_type) with a row per task they can be asked, and its prompt; impossible pairs drop out.

    The prompts are a few dozen rows.
    """
    wanted = samples.withColumns({"category": answers.category(F.col("chart_type")), "task": F.explode(F.array(*map(F.lit, tasks)))})
    return wanted.join(F.broadcast(prompts(samples.sparkSession)), ["task", "category"])
