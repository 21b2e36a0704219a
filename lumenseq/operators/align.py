"""Checks that a model's output lines up with the rows it was given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def misaligned(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Missing, extra, duplicated or reordered predictions; empty when aligned.

    Both sides carry ``seq`` and ``interaction_id``; they must agree one to one.
    """
    counts = lambda df, name: df.groupBy("interaction_id").agg(
        F.count(F.lit(1)).alias(f"{name}_n"), F.min("seq").alias(f"{name}_seq"))
    both = counts(rows, "row").join(counts(predictions, "prediction"), "interaction_id", "full")
    problem = (
        F.when(F.col("prediction_n").isNull(), "missing").when(F.col("row_n").isNull(), "extra")
        .when(F.col("prediction_n") != F.col("row_n"), "duplicate")
        .when(F.col("prediction_seq") != F.col("row_seq"), "reordered")
    )
    return both.select("interaction_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def aligned(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows with their prediction; one-to-one by id, checked for range."""
    p = F.col("probability")
    wrong = p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    checked = F.when(wrong, F.raise_error(F.lit("probability outside [0, 1]")).cast("double")).otherwise(p)
    found = predictions.select("interaction_id", checked.alias("probability"))
    return rows.join(found, "interaction_id")
