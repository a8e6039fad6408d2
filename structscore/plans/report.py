"""Reports over judged rows: one shuffle to buckets, then every view from these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import METRICS

#: The four that every report has; the others are single thresholds.
MAIN = METRICS[:4]

DIMENSIONS = ["model", "source_jsonl", "chart_type", "img_type", "lang_type"]

# Orders of reports; what isn't listed follows by name.
CHART_ORDER = ["柱状图", "折线图", "饼图", "雷达图", "箱线图", "组合图", "流程图", "思维导图"]
LANGUAGE_ORDER = ["英文", "中文"]
FAMILIES = 8


def scored(rows: DataFrame) -> DataFrame:
    """Rows that have a score; rows with an error have none and are left out of means.

    Missing metrics of a scored row count as 0, missing dimensions as 未知.
    """
    metrics = [F.coalesce(F.col(f"score.{m}"), F.lit(0.0)).alias(m) for m in METRICS]
    dims = [F.coalesce(F.col(d), F.lit("未知")).alias(d) for d in DIMENSIONS]
    return rows.filter(F.col("score.map_strict").isNotNull()).select("task", *dims, *metrics)


def buckets(rows: DataFrame, dims: list[str] = DIMENSIONS, metrics: list[str] = METRICS) -> DataFrame:
    """Sums and counts per task and all dimensions: the only pass over rows."""
    return rows.groupBy("task", *dims).agg(*[F.sum(m).alias(m) for m in metrics], F.count("*").alias("count"))


def means(sums: DataFrame, keys: list[str], metrics: list[str] = MAIN) -> DataFrame:
    """Micro averages by `keys`: summed sums over summed counts."""
    return sums.groupBy(*keys).agg(*[F.try_divide(F.sum(m), F.sum("count")).alias(m) for m in metrics], F.sum("count").alias("count"))


def views(sums: DataFrame, sets: list[list[str]], metrics: list[str] = MAIN) -> DataFrame:
    """Several groupings in one aggregation; `view` numbers the keys that are rolled up."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = sums.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id().alias("view"), *[F.try_divide(F.sum(m), F.sum("count")).alias(m) for m in metrics], F.sum("count").alias("count"))


DETAIL = [["chart_type", "img_type", "lang_type"], ["chart_type"], ["img_type"], ["lang_type"], ["chart_type", "img_type"], ["chart_type", "lang_type"]]


def detail(sums: DataFrame) -> DataFrame:
    """The six views of one model and task, for all models and tasks at once."""
    return views(sums, [["model", "task", *s] for s in DETAIL])


def task_sheet(sums: DataFrame, task: str, files: list[str], metrics: list[str] = MAIN) -> DataFrame:
    """model by (all files and each file): metrics side by side; a missing cell is 0."""
    own = sums.filter(F.col("task") == task)
    each = own.groupBy("model").pivot("source_jsonl", files).agg(*[F.try_divide(F.sum(m), F.sum("count")).alias(m) for m in metrics])
    return means(own, ["model"], metrics).join(each, "model").na.fill(0.0)


def overview(sums: DataFrame, tasks: list[str], metrics: list[str] = MAIN) -> DataFrame:
    """model by task: metrics side by side; a missing cell is 0."""
    return sums.groupBy("model").pivot("task", tasks).agg(*[F.try_divide(F.sum(m), F.sum("count")).alias(m) for m in metrics]).na.fill(0.0)


def place(value: Column, order: list[str]) -> Column:
    """Sort key: place in the list, or behind all of it."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(order)).otherwise(at - 1).cast("int")


def ordered(df: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """Rows by listed values first, in list order, the rest by name."""
    return df.orderBy(*[x for c, order in orders.items() for x in (place(F.col(c), order), F.col(c))])


def family_average(per_type: DataFrame, metric: str = "map_high", families: int = FAMILIES) -> DataFrame:
    """Mean over all chart families per model; a missing family counts 0."""
    return per_type.groupBy("model").agg((F.sum(metric) / families).alias("average"))
