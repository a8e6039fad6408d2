"""JSON lines: strict and tolerant scans, folders of models, keyed rewriting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.resume import upserted

# Names of scenes in data, and in reports.
SCENES = {"电子印刷": "打印", "随拍手写": "手写"}


def strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line must parse; a bad one fails the job. Blank lines are no rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that don't parse are left out."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    read = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.filter(F.col("_bad").isNull()).drop("_bad")


def models(spark: SparkSession, root: str, schema: T.StructType, scenes: dict[str, str] | None = None) -> DataFrame:
    """All `*.jsonl` one folder below `root`, with columns model and source_jsonl.

    A folder is a model; names that start with a dot or an underscore are none.
    `scenes` renames img_type for reports.
    """
    read = tolerant(spark, f"{root.rstrip('/')}/*/*.jsonl", schema)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = read.withColumns({"model": F.element_at(parts, -2), "source_jsonl": F.regexp_replace(F.element_at(parts, -1), "\\.jsonl$", "")})
    if scenes and "img_type" in read.columns:
        named = named.replace(scenes, subset=["img_type"])
    return named.filter(~F.col("model").rlike("^[._]"))


def with_place(rows: DataFrame) -> DataFrame:
    """`rows` with their place in the input, for 'last wins' and 'first n'."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("_place", at)


def first(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by place."""
    return with_place(rows).orderBy("_place").limit(n).drop("_place")


def rewrite(old: DataFrame | None, new: DataFrame, keys: list[str], path: str, parts: list[str] | None = None) -> str:
    """Upsert `new` into `old` as a new version under `path`; returns the version's folder.

    The version is complete once its folder has Spark's success mark; readers
    take the one they are told, so nothing is overwritten while it is read.
    """
    rows = new if old is None else upserted(old, new, keys)
    target = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    writer = rows.write
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(target)
    return target


def resolved(path: Column, folder: str) -> Column:
    """An image path as given if absolute, else below `folder`."""
    return F.when(path.startswith("/") | path.rlike("^[a-z][a-z0-9+.-]*://"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))
