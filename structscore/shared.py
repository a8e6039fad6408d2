"""Scratch tables in the folder that driver and executors share; writing one cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: `spark.checkpoint.dir`, else the context's checkpoint folder.

    Only where neither is set and Spark runs in one process (tests) is a local
    temporary folder made and removed at exit; on a cluster this raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "base" not in _LOCAL:
            _LOCAL["base"] = tempfile.mkdtemp(prefix="structscore-")
            atexit.register(shutil.rmtree, _LOCAL["base"], ignore_errors=True)
        base = "file://" + _LOCAL["base"]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/structscore-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` once to the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables from `stored` that nothing will read again."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, name)


def remove_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables that this process made; call it when their results are written."""
    while _MADE:
        delete(spark, _MADE.pop())
