"""Small dataflows that several reports share: modes, trees in tables, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscore.operators import forest


def modes(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each key; of equally common ones the first by `order`."""
    each = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return each.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value))


def depths(rows: DataFrame) -> DataFrame:
    """(id, depth) of an (id, parent) table, roots at 0; as `forest.rooted`, whose rules for odd rows hold."""
    return forest.rooted(rows).select("id", F.col("depth").cast("int").alias("depth"))


def tasks_in(rows: DataFrame) -> DataFrame:
    """Each task once."""
    return rows.select("task").distinct()
