"""Train/valid/test labelling that keeps whole bundles together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.functions import scalars as S
from lumenseq.operators.layout import HotKeys, Running, hot_keys, key_totals, scan
from lumenseq.operators.windows import bundle_table


def _label_rows(df: DataFrame, labelled: DataFrame, bundle: str) -> DataFrame:
    """Attach bundle labels; a large bundle is spread by the adaptive skew join."""
    labels = labelled.select("learner_id", bundle, F.col("_label").alias("split"))
    return df.drop("split").join(labels, ["learner_id", bundle]).select(*df.drop("split").columns, "split")


def fractional_bundle_split(df: DataFrame, train_fraction: float, valid_fraction: float,
                            hot: HotKeys | None = None) -> DataFrame:
    """Whole bundles in first-appearance order, truncated fractions, rest is test."""
    if train_fraction < 0 or valid_fraction < 0:
        raise ValueError("a split fraction is below zero")
    if train_fraction + valid_fraction > 1:
        raise ValueError("train and valid fractions add up to more than one")
    table = bundle_table(df, "first_seq", hot)
    n = F.col("n_bundles")
    train = (n * F.lit(float(train_fraction))).cast("long")
    valid = F.least((n * F.lit(float(valid_fraction))).cast("long"), n - train)
    labelled = table.withColumn("_label", S.split_label(F.col("bundle_rank"), train, valid))
    return _label_rows(df, labelled, "bundle_id")


def solving_split(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """70/10/20 over bundles in numeric solving-id order."""
    table = bundle_table(df, "solving_id", hot, bundle="solving_id")
    train, valid = S.short_history_cut(F.col("n_bundles"))
    labelled = table.withColumn("_label", S.split_label(F.col("bundle_rank"), train, valid))
    return _label_rows(df, labelled, "solving_id")


def temporal_row_split(df: DataFrame, key: str = "learner_id", hot: HotKeys | None = None) -> DataFrame:
    """Nominal 70/10/20 over the rows of each learner in ``seq`` order."""
    hot = hot_keys(df, [key]) if hot is None else hot
    ranked = scan(df.drop("split"), [key], "seq", [Running("_rank", "count")], hot)
    counted = key_totals(ranked, [key], "seq", {"_n": ("sum", F.lit(1))}, hot)
    train, valid = S.short_history_cut(F.col("_n"))
    return counted.withColumn("split", S.split_label(F.col("_rank"), train, valid)).drop("_rank", "_n")


def bundle_closure(df: DataFrame, key: list[str], nominal: str = "split") -> DataFrame:
    """Move TRAIN rows of a bundle that is also in VALID to VALID.

    Appends ``promoted`` and ``crossing``. Only crossing bundles are joined, and
    they are found by a map-side combined aggregate.
    """
    seen = df.groupBy(*key).agg(
        F.max((F.col(nominal) == "train").cast("int")).alias("_t"),
        F.max((F.col(nominal) == "valid").cast("int")).alias("_v"),
    )
    crossing = seen.where("_t = 1 AND _v = 1").select(*key, F.lit(True).alias("_x"))
    joined = df.join(crossing, key, "left")
    hit = F.coalesce(F.col("_x"), F.lit(False))
    promoted = hit & (F.col(nominal) == "train")
    return joined.select(
        *[c for c in df.columns if c != nominal],
        F.when(promoted, "valid").otherwise(F.col(nominal)).alias(nominal),
        promoted.alias("promoted"),
        hit.alias("crossing"),
    )


def split_roles(order: list[str], roles: dict[str, str]) -> list[tuple[str, str]]:
    """Check that every split id has one role and every role is used at most once."""
    if sorted(order) != sorted(roles):
        raise ValueError(f"split_roles must name each split id once: {sorted(roles)} vs {sorted(order)}")
    pairs = [(s, roles[s]) for s in order]
    for split_id, role in pairs:
        if role not in ("train", "valid", "test"):
            raise ValueError(f"split {split_id!r} has role {role!r}")
    if len({r for _, r in pairs}) != len(pairs):
        raise ValueError("a workflow role is assigned to more than one split")
    return pairs


def outside_declared_splits(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows whose split is not declared (null counts as undeclared)."""
    return df.where(~F.coalesce(F.col("split").isin(order), F.lit(False)))


def role_rows(df: DataFrame, roles: list[tuple[str, str]], role: str) -> DataFrame:
    """Rows of the one split declared with ``role``; list position implies nothing."""
    ids = [s for s, r in roles if r == role]
    if len(ids) != 1:
        raise ValueError(f"role {role!r} must match one split, got {ids}")
    return df.where(F.col("split") == ids[0])
