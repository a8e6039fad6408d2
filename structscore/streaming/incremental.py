"""Judging answers as their files arrive.

A stream of JSON lines is scored batch by batch; each batch is appended under
its number, so a batch that is run again after a failure replaces itself.  The
current result is the last row per key, made when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans import judging
from ..plans.resume import last_per_key

ANSWERS = T.StructType([T.StructField(n, T.StringType()) for n in ("model", "img_path", "task", "prediction", "reference")])


def judge_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Judge all files that are in `source` now and weren't judged before: a score, or an error, by each row's task."""
    rows = spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", files_per_batch).json(source)

    def judge(batch: DataFrame, number: int) -> None:
        scored = judging.judge(batch).withColumn("batch", F.lit(number))
        scored.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """One row per model, image and task: that of the last batch that had it, in a batch the last by its texts."""
    return last_per_key(spark.read.parquet(target), ["model", "img_path", "task"], ["batch", "prediction", "reference"])
