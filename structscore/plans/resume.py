"""Runs that go on where the last one stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order` (null last values lose).

    max_by of one struct is combined before the shuffle, so a key with very many
    rows costs one row per task.
    """
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(*order)
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_last"))
    return kept.select(*keys, "_last.*").select(*rows.columns)


def not_done(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `wanted` whose keys `done` lacks."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` with other keys; nothing is deleted."""
    return new.select(*old.columns).unionByName(not_done(old, new, keys).select(*old.columns))


def without_tasks(results: Column, forced: list[str]) -> Column:
    """A map of results without tasks that are to be judged again."""
    return F.map_filter(results, lambda k, _: ~k.isin(forced)) if forced else results


def judgement_error(result_present: Column, prediction: Column, known_task: Column, reference: Column) -> Column:
    """Why a row gets no score, or null.  An empty reference scores 0 and still counts."""
    return (
        F.when(~known_task, "unknown_task")
        .when(~result_present, "no_infer")
        .when(F.coalesce(prediction, F.lit("")) == "", "no_extract")
        .when(F.coalesce(reference, F.lit("")) == "", "no_reference")
    )
