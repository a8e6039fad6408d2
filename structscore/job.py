"""Judging as a job: python -m structscore.job SOURCE TARGET [options].

SOURCE holds JSON lines or Parquet with img_path, task, prediction, reference and
the dimensions of reports; with --models it holds a folder of JSON lines for each
model.  TARGET gets judged, detail and overview tables, and the versions that
`judged` comes from: with --resume only rows are judged that no earlier run has,
or whose task is forced, and they replace those of before.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans import judging, relations, report, resume
from .sources import jsonl, versioned

#: A row of the keyed table; rows without a model are of one without a name.
KEYS = ["model", "img_path", "task"]
COLUMNS = [*KEYS, "prediction", "reference", "source_jsonl", "chart_type", "img_type", "lang_type"]
#: Most different tasks that reports take.
MOST_TASKS = 1000


@dataclass(frozen=True)
class Options:
    source: str
    target: str
    tasks: list[str] = field(default_factory=list)
    first: int | None = None
    loose: bool = False
    skip_missing: bool = False
    tag: str | None = None
    model: str | None = None
    resume: bool = False
    forced: list[str] = field(default_factory=list)
    models: bool = False
    strict: bool = False


def options(given: list[str] | None = None) -> Options:
    p = argparse.ArgumentParser(prog="structscore", description=__doc__)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--tasks", nargs="*", default=[], help="only these tasks")
    p.add_argument("--first", type=int, help="only so many rows, by img_path, which they need")
    p.add_argument("--loose", action="store_true", help="the loose limits")
    p.add_argument("--skip-missing", action="store_true", help="leave rows without a prediction out instead of telling an error")
    p.add_argument("--tag", help="name of the output")
    p.add_argument("--model", help="name or path of the model")
    p.add_argument("--resume", action="store_true", help="judge only what no earlier run has judged; rows need img_path")
    p.add_argument("--forced", nargs="*", default=[], help="tasks that are judged again in any case")
    p.add_argument("--models", action="store_true", help="the source is a folder with one of JSON lines for each model")
    p.add_argument("--strict", action="store_true", help="a line that doesn't parse ends the job")
    return Options(**vars(p.parse_args(given)))


def tag(o: Options) -> str:
    """The name of the output: as given, else the model's last part, else default."""
    return o.tag or (o.model or "").rstrip("/").rsplit("/", 1)[-1] or "default"


def judged(rows: DataFrame, o: Options) -> DataFrame:
    if o.tasks:
        rows = rows.filter(F.col("task").isin(o.tasks))
    if o.skip_missing:
        rows = rows.filter(F.coalesce("prediction", F.lit("")) != "")
    if o.first is not None:
        rows = rows.orderBy("img_path", "task").limit(o.first)
    return judging.judge(rows, o.loose)


def source(spark: SparkSession, o: Options) -> DataFrame:
    """The rows to judge, with KEYS; JSON has a schema of texts and is read once."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    if o.models:
        rows = jsonl.models(spark, o.source, T.StructType([f for f in schema if f.name not in ("model", "source_jsonl")]))
    elif o.source.endswith((".json", ".jsonl")):
        rows = (jsonl.strict if o.strict else jsonl.tolerant)(spark, o.source, schema)
    else:
        rows = spark.read.parquet(o.source)
    return rows.withColumns({c: F.lit(None).cast("string") for c in [*KEYS, *report.DIMENSIONS] if c not in rows.columns})


def pending(rows: DataFrame, done: DataFrame, forced: list[str]) -> DataFrame:
    """Rows that `done` has no judgement of, and those of forced tasks."""
    held = done.filter(~F.col("task").isin(forced)) if forced else done
    named = lambda df: df.withColumns({f"_{c}": F.coalesce(c, F.lit("")) for c in KEYS})
    return resume.not_done(named(rows), named(held), [f"_{c}" for c in KEYS]).drop(*[f"_{c}" for c in KEYS])


def run(spark: SparkSession, o: Options) -> str:
    """Write the judged rows and their reports; the folder that holds them.

    Without --resume a run starts over.  With it rows are kept under KEYS (a null
    is an empty text there): of rows that repeat a key the last by its texts
    counts.
    """
    folder = f"{o.target.rstrip('/')}/{tag(o)}"
    rows = source(spark, o)
    if o.resume:
        kept = f"{folder}/versions"
        if versioned.manifest(spark, kept):
            rows = pending(rows, versioned.read(spark, kept), o.forced)
        new = judged(rows.withColumns({c: F.coalesce(c, F.lit("")) for c in KEYS}), o)
        versioned.upsert(new, kept, KEYS, ["prediction", "reference"])
        versioned.read(spark, kept).write.mode("overwrite").parquet(f"{folder}/judged")
    else:
        judged(rows, o).write.mode("overwrite").parquet(f"{folder}/judged")
    rows = spark.read.parquet(f"{folder}/judged")
    sums = report.buckets(report.scored(rows))
    report.detail(sums).write.mode("overwrite").parquet(f"{folder}/detail")
    tasks = sorted(r.task for r in relations.tasks_in(rows).limit(MOST_TASKS + 1).collect() if r.task)
    if len(tasks) > MOST_TASKS:
        raise ValueError(f"more than {MOST_TASKS} different tasks: name those that the overview is to have")
    report.overview(sums, tasks).write.mode("overwrite").parquet(f"{folder}/overview")
    return folder


if __name__ == "__main__":
    session = SparkSession.builder.appName("structscore").getOrCreate()
    print(run(session, options()))
