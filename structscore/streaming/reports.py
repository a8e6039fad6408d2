"""Reports that are kept up to date while rows are judged, and judged again.

State holds the last score of every key.  A row that is judged again gives two
changes: its old score with the sign turned, and the new one.  Each batch writes
its changes summed by bucket under its number, so a batch that runs again
replaces itself; a report sums the bucket table, whose size doesn't depend on
how many rows were judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.matching import METRICS
from ..plans import report

KEYS = ["model", "img_path", "task"]
DIMENSIONS = [d for d in report.DIMENSIONS if d != "model"]

#: Judged rows as they arrive; `place` tells which of two judgements of a key is the later one.
ROWS = T.StructType(
    [T.StructField(n, T.StringType()) for n in [*KEYS, *DIMENSIONS]] + [T.StructField("place", T.LongType())] + [T.StructField(m, T.DoubleType()) for m in METRICS]
)
CHANGES = T.StructType([*ROWS.fields, T.StructField("count", T.LongType())])
_HELD = [*DIMENSIONS, *METRICS]
STATE = T.StructType([T.StructField("place", T.LongType()), *[f for f in ROWS.fields if f.name in _HELD]])


def _changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a key's new rows change: its row of before goes, its last one comes; an older or unscored row changes nothing or takes the score away."""
    last: pd.Series | None = None
    for part in parts:
        top = part.sort_values(["place", *METRICS]).iloc[-1]
        if last is None or top["place"] >= last["place"]:
            last = top
    before = dict(zip(STATE.fieldNames(), state.get, strict=True)) if state.exists else None
    if last is None or before is not None and before["place"] > last["place"]:
        return
    after = {"place": int(last["place"]), **{n: None if pd.isna(last[n]) else last[n] for n in _HELD}}
    state.update(tuple(float(after[n]) if n in METRICS and after[n] is not None else after[n] for n in STATE.fieldNames()))
    rows = []
    for row, sign in ((before, -1), (after, 1)):
        if row is not None and row["map_strict"] is not None:  # rows without a score are in no mean
            rows.append([*key, *[row[d] for d in DIMENSIONS], row["place"], *[sign * (row[m] or 0.0) for m in METRICS], sign])
    if rows:
        yield pd.DataFrame(rows, columns=CHANGES.fieldNames())


def keep_reports(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Take in all files of judged rows (JSON lines, ROWS) that are in `source` now and weren't before.

    A row without a key is left out.  Of several rows of a key the one with the
    greatest `place` counts, in whatever batch it came; of equal places the later
    batch, inside a batch the greatest scores.
    """
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).json(source).dropna(subset=[*KEYS, "place"])
    changes = rows.groupBy(*KEYS).applyInPandasWithState(_changes, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        dims = [F.coalesce(F.col(d), F.lit("未知")).alias(d) for d in report.DIMENSIONS]
        sums = batch.select("task", *dims, *METRICS, "count").groupBy("task", *report.DIMENSIONS)
        sums.agg(*[F.sum(m).alias(m) for m in METRICS], F.sum("count").alias("count")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_buckets(spark: SparkSession, target: str) -> DataFrame:
    """The bucket table as of the last batch, for any view of `plans.report`; buckets that nothing is left of are gone."""
    read = spark.read.parquet(target).groupBy("task", *report.DIMENSIONS)
    return read.agg(*[F.sum(m).alias(m) for m in METRICS], F.sum("count").alias("count")).where("count > 0")


def compact(spark: SparkSession, target: str, into: str) -> None:
    """The bucket table as one, for a report or a new start; it stands for all batches up to now."""
    current_buckets(spark, target).write.mode("overwrite").parquet(f"{into}/batch=-1")
