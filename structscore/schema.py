"""Schemas of the relations that jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

from .functions.matching import METRICS

SAMPLE = T.StructType([T.StructField(n, T.StringType(), n != "img_path") for n in ("img_path", "chart_type", "img_type", "lang_type", "anno")])

RESULT = T.StructType(
    [
        T.StructField("thinking", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("extract", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
INFER = T.StructType([*SAMPLE.fields, T.StructField("infer_results", T.MapType(T.StringType(), RESULT))])

SCORE = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])
JUDGEMENT = T.StructType([T.StructField("score", SCORE), T.StructField("error", T.StringType())])
JUDGED = T.StructType([*INFER.fields, T.StructField("judge_results", T.MapType(T.StringType(), JUDGEMENT))])
