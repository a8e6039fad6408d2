"""Scores of predicted tables against reference tables, a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching, tables


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with columns that later steps read as they are.

    One explode of one struct: the optimizer moves neither filters nor copies of
    the expressions across it, where these would multiply with every reader.
    """
    keep = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return df.select(*keep, made.alias("_made")).select(*keep, *[F.col(f"_made.{k}").alias(k) for k in columns])


def parsed(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """`df` with both texts as tables, in columns pred_rows and ref_rows; one expression reads either."""
    keep = df.columns
    df = settled(df, {"_read": F.transform(F.array(prediction, reference), tables.any_table)})
    return df.select(*keep, F.get("_read", F.lit(0)).alias("pred_rows"), F.get("_read", F.lit(1)).alias("ref_rows"))


def with_triples(df: DataFrame) -> DataFrame:
    """pred and ref triples of aligned tables, from columns pred_rows and ref_rows."""
    keep = df.columns
    df = settled(df, {"_t": tables.aligned(F.col("pred_rows"), F.col("ref_rows"))})
    # one expression for both sides: it is planned once
    df = df.select(*keep, F.array("_t.pred", "_t.ref").alias("_both"))
    df = settled(df, {"_keys": F.transform("_both", lambda rows: F.struct(tables.header_keys(rows).alias("columns"), tables.row_keys(rows).alias("names")))})
    df = settled(df, {"_listed": F.zip_with("_both", "_keys", lambda rows, k: tables.triples(rows, k["columns"], k["names"]))})
    df = df.select(*keep, F.get("_listed", F.lit(0)).alias("_tp"), F.get("_listed", F.lit(1)).alias("_tr"))
    df = settled(df, {"_names": tables.names_of(F.col("_tr")), "_subjects": tables.box_subjects(F.col("_tr"))})
    df = settled(
        df,
        {
            "_tail": tables.shared_length(F.col("_names"), True),
            "_head": tables.shared_length(F.col("_names"), False),
            "_box": tables.with_subject(F.col("_tp"), F.col("_subjects")),
        },
    )
    df = settled(df, {"_own": tables.names_of(F.col("_box"))})
    df = settled(df, {"_ended": tables.with_shared(F.col("_box"), F.col("_own"), F.col("_names"), F.col("_tail"), True)})
    begun = tables.with_shared(F.col("_tp"), F.col("_own"), F.col("_names"), F.col("_head"), False)
    df = settled(df, {"_full": F.when(F.col("_ended") == F.col("_tp"), begun).otherwise(F.col("_ended"))})
    df = settled(df, {"pred": tables.without_optional(F.col("_full"), F.col("_tr")), "ref": F.col("_tr")})
    return df.select(*keep, "pred", "ref")


def with_scores(df: DataFrame, loose: bool = False) -> DataFrame:
    """`score`, the thirteen values, and the similarities, from columns pred and ref."""
    limits = matching.LOOSE_TOLERANCES if loose else matching.TOLERANCES
    df = settled(df, {f"sim_{n}": matching.similarity(F.col("pred"), F.col("ref"), words, error) for n, (words, error) in limits.items()})
    return settled(df, {"score": matching.scores({n: F.col(f"sim_{n}") for n in limits})})


def score_tables(df: DataFrame, prediction: str = "prediction", reference: str = "reference", turn_weak: bool = True, loose: bool = False) -> DataFrame:
    """`df` with `score` and the three similarities.

    With `turn_weak`, a row whose map_high is below a half is scored once more
    with its prediction transposed, and the better one stays; other rows have an
    empty table there and pay nothing.  Null texts are empty tables and score 0.
    """
    made = ["score", "sim_strict", "sim_slight", "sim_high"]
    first = with_scores(with_triples(parsed(df, prediction, reference)), loose)
    if not turn_weak:
        return first.select(*df.columns, *made)
    once = {c: f"first_{c}" for c in made}
    weak = F.col("first_score.map_high") < 0.5
    none = F.array().cast("array<array<string>>")
    second = first.withColumnsRenamed(once).drop("pred", "ref")
    second = settled(second, {"pred_rows": F.when(weak, tables.transpose(F.col("pred_rows"))).otherwise(none), "ref_rows": F.when(weak, F.col("ref_rows")).otherwise(none)})
    again = with_scores(with_triples(second), loose)
    better = weak & (F.col("score.map_high") > F.col("first_score.map_high"))
    return again.select(*df.columns, *[F.when(better, F.col(c)).otherwise(F.col(k)).alias(c) for c, k in once.items()])
