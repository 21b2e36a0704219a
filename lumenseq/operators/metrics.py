"""Masked NLL, Brier and AUC as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.functions import scalars as S
from lumenseq.operators.layout import range_prefix

HEADLINE_TOLERANCE = 1e-12


def masked(df: DataFrame) -> DataFrame:
    return df.where(F.col("metric_mask"))


def score(df: DataFrame, p: str = "probability", group: list[str] | None = None) -> DataFrame:
    """NLL, Brier, AUC and n in one pass; no rows without a group means an empty result.

    Rows are first reduced to distinct scores with map-side combining, so one
    popular score is no hot spot. AUC is Mann-Whitney with average ranks for ties
    (0.5 when one class is missing); ranks come from running sums over scores that
    are range-partitioned, not from one sorted task.
    """
    group = group or []
    scores = df.groupBy(*group, p).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("correct").cast("long")).alias("_pos")
    )
    ranked = range_prefix(scores, [*group, p], {"_before": F.col("_n")})
    hit, miss, at = F.col("_pos"), F.col("_n") - F.col("_pos"), F.col(p)
    term = lambda fn: hit * fn(F.lit(1), at) + miss * fn(F.lit(0), at)
    # The running count minus the group's own start is the rank inside the group.
    parts = ranked.groupBy(*group).agg(
        F.sum(term(S.nll_term)).alias("_nll"),
        F.sum(term(S.brier_term)).alias("_brier"),
        F.sum(hit * (F.col("_before") + (F.col("_n") + 1) / 2.0)).alias("_rank"),
        F.min("_before").alias("_start"),
        F.sum("_pos").alias("_p"),
        F.sum("_n").alias("n"),
    ).where("n > 0")
    pos = F.col("_p").cast("double")
    neg = (F.col("n") - F.col("_p")).cast("double")
    value = (F.col("_rank") - pos * F.col("_start") - pos * (pos + 1) / 2.0) / (pos * neg)
    return parts.select(
        *group, (F.col("_nll") / F.col("n")).alias("nll"), (F.col("_brier") / F.col("n")).alias("brier"),
        F.when((pos == 0) | (neg == 0), 0.5).otherwise(value).alias("auc"), "n",
    )


def auc(df: DataFrame, p: str = "probability", group: list[str] | None = None) -> DataFrame:
    return score(df, p, group).select(*(group or []), "auc")


def masked_metrics(df: DataFrame, p: str = "probability", group: list[str] | None = None) -> DataFrame:
    return score(masked(df), p, group)


def headline_and_global(df: DataFrame) -> DataFrame:
    """Scores of ``probability`` and ``p_global`` side by side, one stacked pass."""
    stacked = masked(df).select(
        "correct",
        F.explode(F.array(
            F.struct(F.lit("headline").alias("score"), F.col("probability").alias("p")),
            F.struct(F.lit("global").alias("score"), F.col("p_global").alias("p")),
        )).alias("_s"),
    ).select("correct", "_s.score", "_s.p")
    return score(stacked, "p", ["score"])


def within_tolerance(actual: DataFrame, expected: dict[str, float], tolerance: float = HEADLINE_TOLERANCE) -> DataFrame:
    """One row: whether nll, brier and auc all match; NaN and missing fail."""
    close: Column = F.lit(True)
    for name in ("nll", "brier", "auc"):
        want = F.lit(float(expected[name]))
        gap = F.abs(F.col(name) - want)
        close = close & F.coalesce(~F.isnan(gap) & (gap <= tolerance), F.lit(False))
    return actual.select("nll", "brier", "auc", "n", close.alias("ok"))


def deterministic_losses(df: DataFrame, p: str = "probability", learner: str = "learner_id") -> DataFrame:
    """Loss sums rounded to a fixed decimal grid, so merge order cannot change them.

    Every term is scaled to a 1e-18 decimal grid before it is added; decimal
    addition is exact, so any partitioning gives the same digits.
    """
    exact = lambda c: F.sum(c.cast("decimal(28,18)"))
    y = F.col("correct")
    return masked(df).agg(
        (exact(S.nll_term(y, F.col(p))).cast("double") / F.count(F.lit(1))).alias("nll"),
        (exact(S.brier_term(y, F.col(p))).cast("double") / F.count(F.lit(1))).alias("brier"),
        F.count(F.lit(1)).alias("n"),
    )


def early_stop(epochs: DataFrame, min_delta: float, patience: int, key: str = "run") -> DataFrame:
    """Replay the early-stop rule over per-epoch validation rows of each run.

    One row per epoch, so a group holds at most the configured epoch count. Columns ``nll`` and ``brier``, where present,
    give ``best_nll`` and ``best_brier``: their values at the best epoch.
    """
    losses = [c for c in ("nll", "brier") if c in epochs.columns]

    def track(pdf):
        pdf = pdf.sort_values("epoch").reset_index(drop=True)
        best, best_epoch, waited, stopped = -1.0, -1, 0, False
        best_losses = [None] * len(losses)
        rows = []
        for i, (epoch, value) in enumerate(zip(pdf["epoch"], pdf["auc"])):
            if stopped:
                break
            if value > best + min_delta:
                best, best_epoch, waited = float(value), int(epoch), 0
                best_losses = [float(pdf[c][i]) for c in losses]
            else:
                waited += 1
            stopped = waited >= patience
            rows.append((best, best_epoch, waited, stopped, *best_losses))
        out = pdf.iloc[: len(rows)][[key, "epoch", "auc"]].copy()
        out[["best_auc", "best_epoch", "waited", "stop", *[f"best_{c}" for c in losses]]] = rows
        return out

    schema = f"{key} {epochs.schema[key].dataType.simpleString()}, epoch long, auc double, best_auc double, best_epoch long, waited long, stop boolean" + "".join(f", best_{c} double" for c in losses)
    return epochs.groupBy(key).applyInPandas(track, schema)
