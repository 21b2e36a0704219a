"""Run detection, previous-value comparison and bundle ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.operators.layout import HotKeys, Running, hot_keys, order_columns, scan


def with_previous(df: DataFrame, columns: dict[str, Column], hot: HotKeys | None = None,
                  key: list[str] | None = None, order: str = "seq") -> DataFrame:
    """Last non-null earlier value of each expression inside the key."""
    specs = [Running(name, "last", value) for name, value in columns.items()]
    return scan(df, key or ["learner_id"], order, specs, hot)


def _run_starts(df: DataFrame, bundle: str, physical: bool, hot: HotKeys | None,
                key: list[str], order: str | list[str]) -> DataFrame:
    at = F.col(order_columns(order)[0])
    previous = F.struct(F.col(bundle).alias("b"), at.alias("s"))
    seen = scan(df, key, order, [Running("_prev", "last", previous)], hot)
    cut = F.col("_prev").isNull() | ~F.col("_prev.b").eqNullSafe(F.col(bundle))
    if physical:
        cut = cut | (at != F.col("_prev.s") + 1)
    return seen.withColumn("run_start", cut.cast("long")).drop("_prev")


def runs(df: DataFrame, bundle: str = "bundle_id", physical: bool = False,
         hot: HotKeys | None = None, key: list[str] | None = None, order: str | list[str] = "seq") -> DataFrame:
    """Append run columns to rows.

    ``run`` counts runs inside the key from 0, ``run_start`` marks first rows,
    ``row_in_key`` is the row index and ``revealed`` the rows before the run.
    With ``physical`` a foreign row in between also ends the run; that needs a
    dense global ``order``.
    """
    key = key or ["learner_id"]
    hot = hot_keys(df, key) if hot is None else hot
    started = _run_starts(df, bundle, physical, hot, key, order)
    indexed = scan(
        started, key, order,
        [Running("_run", "sum", F.col("run_start"), inclusive=True), Running("row_in_key", "count")],
        hot,
    )
    at = F.col(order_columns(order)[0])
    first = F.when(F.col("run_start") == 1, F.struct(F.col("row_in_key").alias("i"), at.alias("s")))
    anchored = scan(indexed, key, order, [Running("_first", "last", first, inclusive=True)], hot)
    return anchored.select(
        *df.columns,
        (F.col("_run") - 1).cast("long").alias("run"),
        "run_start",
        F.col("row_in_key").cast("long").alias("row_in_key"),
        F.col("_first.i").cast("long").alias("revealed"),
        F.col("_first.s").cast("long").alias("run_first_seq"),
    )


def run_spans(with_runs: DataFrame, key: list[str] | None = None, order: str = "seq") -> DataFrame:
    """One row per run: first and last position and row count."""
    key = key or ["learner_id"]
    return with_runs.groupBy(*key, "run").agg(
        F.min(order).alias("run_first"), F.max(order).alias("run_last"), F.count(F.lit(1)).alias("run_rows")
    )


def revisits(df: DataFrame, bundle: str = "bundle_id", hot: HotKeys | None = None,
             order: str = "seq") -> DataFrame:
    """Run starts whose bundle already appeared earlier in the same learner."""
    started = _run_starts(df, bundle, False, hot, ["learner_id"], order)
    starts = started.where(F.col("run_start") == 1)
    first = starts.groupBy("learner_id", bundle).agg(F.min(order).alias("_first"))
    return starts.join(first, ["learner_id", bundle]).where(F.col(order) > F.col("_first")).drop("_first", "run_start")


def later_duplicates(df: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Rows whose key occurred earlier; the first occurrence is kept out."""
    first = df.groupBy(*key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return df.join(first, key).where(F.col(order) > F.col("_first")).drop("_first", "_n")


def bundle_table(df: DataFrame, rank_by: str, hot: HotKeys | None = None,
                 bundle: str = "bundle_id") -> DataFrame:
    """One row per learner and bundle with its rank and the learner's bundle count.

    ``rank_by`` is ``first_seq`` for first appearance or a bundle-level integer
    column of ``df`` (for example the solving id).
    """
    bundles = df.groupBy("learner_id", bundle).agg(
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("bundle_rows"),
        *([F.min(rank_by).alias(rank_by)] if rank_by not in ("first_seq", bundle) else []),
    )
    ranked = scan(bundles, ["learner_id"], rank_by, [Running("bundle_rank", "count")], hot)
    counts = bundles.groupBy("learner_id").agg(F.count(F.lit(1)).alias("n_bundles"))
    return ranked.join(counts, "learner_id")
