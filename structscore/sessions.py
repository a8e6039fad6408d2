"""The engine's rules as SQL functions and views of a session, for those who write SQL alone.

Functions are temporary SQL functions: Spark puts their expressions in place, so
a query with them is planned like one without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.matching import THRESHOLDS, TOLERANCES
from .plans import report

_PASSED = " + ".join(f"CASE WHEN sim >= {t}D THEN 0.1D ELSE 0D END" for t in THRESHOLDS)

#: Name, parameters, type and body of every function.
FUNCTIONS = {
    "plain_number": ("word STRING", "DOUBLE", "CASE WHEN trim(word) RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' THEN try_cast(trim(word) AS DOUBLE) END"),
    "plain_name": ("word STRING", "STRING", "translate(trim(word), '：（），；％µ', ':(),;%μ')"),
    "near_name": ("said STRING, meant STRING, edits INT", "BOOLEAN", "CASE WHEN edits = 0 THEN said = meant ELSE levenshtein(said, meant) <= edits END"),
    "near_number": (
        "said DOUBLE, meant DOUBLE, error DOUBLE",
        "BOOLEAN",
        "coalesce(NOT isnan(abs(said - meant) / nullif(meant + 0.000001D, 0D)) AND abs(said - meant) / nullif(meant + 0.000001D, 0D) <= error, false)",
    ),
    "overlap": ("found BIGINT, exact BIGINT, distinct_both BIGINT", "DOUBLE", "coalesce(try_divide(CAST(found AS DOUBLE), CAST(distinct_both - found + exact AS DOUBLE)), 0D)"),
    "averaged": ("sim DOUBLE", "DOUBLE", _PASSED),
}


def install(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS, and the view `tolerances` (name, edits, error); the names made."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    limits = ", ".join(f"('{n}', {w}, {e}D)" for n, (w, e) in TOLERANCES.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW tolerances AS SELECT * FROM VALUES {limits} AS t(name, edits, error)")
    return [*FUNCTIONS, "tolerances"]


def views(judged: DataFrame, prefix: str = "") -> list[str]:
    """The views `judged`, `scored` (rows that are in means) and `buckets` (their sums) of judged rows; the names made."""
    scored = report.scored(judged)
    made = {"judged": judged, "scored": scored, "buckets": report.buckets(scored)}
    for name, df in made.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in made]
