"""The job goes on where it stopped; SQL functions give what the columns give."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from structscore import job, sessions
from structscore.functions import matching
from structscore.plans import judging


def test_resumed_runs(spark, tmp_path, monkeypatch):
    """Only rows that no run has, and those of forced tasks, are judged; they replace what was there."""
    asked: list[int] = []

    def scores(rows, loose=False):
        asked.append(len(rows.collect()))
        score = F.struct(*[F.lit(0.5).alias(m) for m in matching.METRICS])
        return rows.withColumns({"score": F.when(F.col("prediction") != "", score), "error": F.when(F.col("prediction") == "", "no_extract")})

    monkeypatch.setattr(judging, "judge", scores)
    source, target = str(tmp_path / "in.jsonl"), str(tmp_path / "out")

    def wrote(rows):
        (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(dict(zip(("img_path", "task", "prediction", "reference"), r, strict=True))) for r in rows) + "\nnot json\n")

    def run(*more):
        folder = job.run(spark, job.options([source, target, "--resume", *more]))
        return {(r.img_path, r.task): r.prediction for r in spark.read.parquet(f"{folder}/judged").collect()}

    wrote([("a", "SE_MD", "1", "r"), ("b", "SE_MD", "2", "r"), ("a", "SE_CSV", "3", "r")])
    assert run() == {("a", "SE_MD"): "1", ("b", "SE_MD"): "2", ("a", "SE_CSV"): "3"}
    wrote([("a", "SE_MD", "changed", "r"), ("a", "SE_CSV", "again", "r"), ("c", "SE_MD", "4", "r"), (None, "SE_MD", "5", "r")])
    want = {("a", "SE_MD"): "1", ("b", "SE_MD"): "2", ("a", "SE_CSV"): "again", ("c", "SE_MD"): "4", ("", "SE_MD"): "5"}
    assert run("--forced", "SE_CSV") == want and run() == want
    assert asked == [3, 3, 0]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        job.run(spark, job.options([source, target, "--strict"]))


def test_folder_of_models(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(judging, "judge", lambda rows, loose=False: rows.withColumns({"score": F.struct(*[F.lit(1.0).alias(m) for m in matching.METRICS]), "error": F.lit(None).cast("string")}))
    for model, n in (("m1", 2), ("m2", 1), ("_report", 3)):
        (tmp_path / "in" / model).mkdir(parents=True)
        (tmp_path / "in" / model / "f.jsonl").write_text("\n".join(json.dumps({"img_path": str(i), "task": "SE_MD", "prediction": "p", "reference": "r"}) for i in range(n)))
    folder = job.run(spark, job.options([str(tmp_path / "in"), str(tmp_path / "out"), "--models", "--tag", "t"]))
    assert {(r.model, r.SE_MD_em) for r in spark.read.parquet(f"{folder}/overview").select("model", F.col(spark.read.parquet(f"{folder}/overview").columns[1]).alias("SE_MD_em")).collect()} == {("m1", 1.0), ("m2", 1.0)}


def test_sql_functions_give_what_columns_give(spark):
    assert set(sessions.install(spark)) >= set(sessions.FUNCTIONS)
    names = [("abc", "abd"), ("abc", "xyz"), ("", ""), (None, "a")]
    numbers = [(1.0, 1.04), (1.0, 2.0), (5.0, -3.0), (0.001, 0.0), (float("nan"), 1.0), (None, 1.0), (1.0, -0.000001)]
    df = spark.createDataFrame([(a, b, x, y) for a, b in names for x, y in numbers], "a string, b string, x double, y double")
    item = lambda k, v: F.struct(F.col(k).alias("k0"), F.lit("").alias("k1"), F.col(v).alias("num"), F.lit(None).cast("string").alias("txt"))
    for words, error in matching.TOLERANCES.values():
        both = f"coalesce(near_name(a, b, {words}) AND near_number(x, y, {error}D), false)"
        rows = df.where("x IS NOT NULL").select(F.expr(both).alias("sql"), matching.matches(item("a", "x"), item("b", "y"), words, error).alias("column")).collect()
        assert all(r.sql == r.column for r in rows), rows
    sims = spark.range(101).select((F.col("id") / 100).alias("s")).select(F.expr("averaged(s)").alias("sql"), matching.averaged(F.col("s")).alias("column"))
    assert sims.where("abs(sql - column) > 1e-12").count() == 0
    judged = spark.createDataFrame([("SE_MD", "m", 1.0), ("SE_MD", "m", None)], "task string, model string, s double")
    judged = judged.select("task", "model", *[F.lit("x").alias(d) for d in ("source_jsonl", "chart_type", "img_type", "lang_type")], F.struct(*[F.col("s").alias(m) for m in matching.METRICS]).alias("score"))
    assert sessions.views(judged, "t_") == ["t_judged", "t_scored", "t_buckets"]
    assert spark.sql("SELECT sum(em) / sum(count) AS mean, sum(count) AS n FROM t_buckets").first() == (1.0, 1)
