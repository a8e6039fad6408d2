"""Distinct counts in every view of a report: exact ones from rows, mergeable ones from the bucket table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sketch's size: 2^12 slots, about 1.6 % standard error.
SKETCH_BITS = 12


def sketched_buckets(rows: DataFrame, dims: list[str], value: str, bits: int = SKETCH_BITS) -> DataFrame:
    """A sketch of `value` for every combination of `dims`, some 2.5 KB each; nulls don't count."""
    return rows.groupBy(*dims).agg(F.hll_sketch_agg(F.col(value), bits).alias("sketch"), F.count("*").alias("count"))


def _grouped(df: DataFrame, sets: list[list[str]]):
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])


def estimated_views(buckets: DataFrame, sets: list[list[str]]) -> DataFrame:
    """For each grouping in `sets` (`view` numbers it): rows and estimated distinct values, by merging sketches alone."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about")
    return _grouped(buckets, sets).agg(F.grouping_id().cast("long").alias("view"), F.sum("count").alias("count"), merged)


def exact_views(rows: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """The same with exact distinct counts, over values that are made distinct per finest bucket first."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    once = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return _grouped(once, sets).agg(F.grouping_id().cast("long").alias("view"), F.sum("_n").alias("count"), F.count_distinct(value).alias("exact"))
