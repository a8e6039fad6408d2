"""Results of models as VARIANT: whatever shape a task's result has, one row a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prediction_of(extract: Column, answer: Column) -> Column:
    """The text that is judged: an extract's table, the extract if it is a text itself, the answer where there is no extract.

    A list, a number or an object without a table is an empty text; so is a null answer.
    """
    kind = F.schema_of_variant(extract)
    told = (
        F.when(extract.isNull() | F.is_variant_null(extract), answer)
        .when(kind.startswith("OBJECT"), F.try_variant_get(extract, "$.extracted_table", "string"))
        .when(kind == "STRING", F.try_variant_get(extract, "$", "string"))
    )
    return F.coalesce(told, F.lit(""))


def task_results(rows: DataFrame, column: str = "infer_results") -> DataFrame:
    """`rows` by task: its other columns, task, answer, prediction and error.

    `column` is JSON text, an object of results by task.  A text that isn't JSON
    or isn't an object gives one row with the error `bad_results` and no task; an
    empty object and a null give none.  A result that is no object has neither
    answer nor extract.  `error` is the result's own, or `no_extract` where there
    is nothing to judge.  Of a task that an object names twice the last counts.
    """
    rest = [c for c in rows.columns if c != column]
    parsed = rows.withColumn("_v", F.try_parse_json(F.col(column))).where(F.col(column).isNotNull())
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    bad = parsed.where(~is_object).select(*rest, *[F.lit(None).cast("string").alias(c) for c in ("task", "answer", "prediction")], F.lit("bad_results").alias("error"))
    # other columns go along in a struct: their names may be those of the function's
    held = parsed.where(is_object).select("_v", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    each = held.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    text = lambda name: F.try_variant_get("value", f"$.{name}", "string")
    read = each.select(*[F.col(f"_rest.{c}") for c in rest], F.col("key").alias("task"), text("answer").alias("answer"), F.try_variant_get("value", "$.extract", "variant").alias("_extract"), text("error").alias("_error"))
    read = read.withColumn("prediction", prediction_of(F.col("_extract"), F.col("answer")))
    error = F.coalesce("_error", F.when(F.col("prediction") == "", "no_extract"))
    return read.select(*rest, "task", "answer", "prediction", error.alias("error")).unionByName(bad)
