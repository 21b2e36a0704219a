"""Vocabularies, dense encoding and out-of-vocabulary policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.operators.layout import ordinal

FITTED = ("train", "valid")
PSYCHOMETRIC = ("irt", "ar_kt")
SEQUENCE = ("dkt_q", "dkt_qc", "dkvmn_q", "dkvmn_qc")


def fitted_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("split").isin(*FITTED))


def distinct_ids(df: DataFrame, column: Column, name: str = "id") -> DataFrame:
    return df.select(column.alias(name)).where(F.col(name).isNotNull()).distinct()


def vocabulary(df: DataFrame, column: Column, name: str = "id") -> DataFrame:
    """Distinct ids in sorted order with a dense index (strings sort by code point)."""
    return ordinal(distinct_ids(df, column, name), [name], "idx")


def kc_vocabulary(df: DataFrame, kc: str = "kc_ids") -> DataFrame:
    """Distinct KC ids in numeric order; a negative id fails the query."""
    exploded = df.select(F.explode(kc).alias("id"))
    checked = exploded.select(
        F.when(F.col("id") < 0, F.raise_error(F.concat(F.lit("negative kc id "), F.col("id").cast("string"))).cast("long"))
        .otherwise(F.col("id")).alias("id")
    )
    return ordinal(checked.distinct(), ["id"], "idx")


def encode(df: DataFrame, vocab: DataFrame, column: str, index: str) -> DataFrame:
    """Left join an id column to its dense index; null index means unknown.

    Join strategy is left to the optimizer: a small vocabulary is broadcast by
    its measured size, a large one is shuffled with skew handling.
    """
    keyed = vocab.select(F.col("id").alias("_id"), F.col("idx").alias(index))
    return df.join(keyed, F.col(column) == F.col("_id"), "left").drop("_id")


def encode_kcs(df: DataFrame, vocab: DataFrame, kc: str = "kc_ids", out: str = "tag_idxs",
               unknown: str = "drop", row_key: str = "seq") -> DataFrame:
    """Encode the KC array keeping order and repeats; unknown ids drop or fail.

    Only distinct arrays are exploded and joined, so the work follows the number
    of different KC lists (one per item), not the number of rows.
    """
    lists = df.select(F.col(kc).alias("_kc")).distinct()
    tokens = lists.select("_kc", F.posexplode("_kc").alias("_pos", "_token"))
    keyed = vocab.select(F.col("id").alias("_token"), F.col("idx").alias("_idx"))
    found = tokens.join(keyed, "_token", "left")
    if unknown == "error":
        found = found.withColumn(
            "_idx",
            F.when(F.col("_idx").isNull(), F.raise_error(F.concat(F.lit("kc not in vocabulary: "), F.col("_token").cast("string"))).cast("long"))
            .otherwise(F.col("_idx")),
        )
    elif unknown != "drop":
        raise ValueError(f"unknown must be 'drop' or 'error', got {unknown!r}")
    packed = found.where(F.col("_idx").isNotNull()).groupBy("_kc").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_idx"))), lambda x: x["_idx"]).alias(out)
    )
    joined = df.join(packed, df[kc] == packed["_kc"], "left").drop("_kc")
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<bigint>")))


def group_table(df: DataFrame, key: list[str], name: str = "group_id") -> DataFrame:
    """Dense id of each distinct key in sorted order."""
    return ordinal(df.select(*key).distinct(), key, name)


def group_ids(df: DataFrame, key: list[str], name: str = "group_id") -> DataFrame:
    """Dense id of the sorted distinct key, joined back to the rows."""
    return df.join(group_table(df, key, name), key)


def fill_group_ids(df: DataFrame, key: list[str], existing: str = "group_id", order: str = "seq") -> DataFrame:
    """Give rows without an id a new one after the maximum, by first appearance of the key."""
    missing = F.col(existing).isNull() | (F.col(existing) < 0)
    base = df.agg(F.coalesce(F.max(F.when(~missing, F.col(existing))) + 1, F.lit(0)).alias("_base"))
    firsts = df.where(missing).groupBy(*key).agg(F.min(order).alias("_first"))
    # A one-row aggregate is broadcast.
    numbered = ordinal(firsts, ["_first"], "_n").crossJoin(F.broadcast(base))
    fresh = numbered.select(*key, (F.col("_n") + F.col("_base")).alias("_fresh"))
    joined = df.join(fresh, key, "left")
    return joined.withColumn(existing, F.when(missing, F.col("_fresh")).otherwise(F.col(existing))).drop("_fresh")


def oov_counts(test: DataFrame, vocab_ids: DataFrame, column: str = "item_id") -> DataFrame:
    """Rows and distinct ids of ``test`` that are missing from the vocabulary."""
    missing = test.join(vocab_ids.select(F.col("id").alias(column)), column, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("oov_rows"), F.countDistinct(column).alias("oov_types"))


def apply_oov_policy(df: DataFrame, family: str, index: str = "problem_idx") -> DataFrame:
    """Unknown items: sentinel 0 and masked for psychometric models, dropped for sequence models."""
    unknown = F.col(index).isNull()
    if family in PSYCHOMETRIC:
        return df.withColumn("metric_mask", F.col("metric_mask") & ~unknown).withColumn(
            index, F.coalesce(F.col(index), F.lit(0).cast("long"))
        )
    if family in SEQUENCE:
        return df.where(~unknown)
    raise ValueError(f"unknown model family {family!r}")


def kt1_phase_rows(df: DataFrame, phase: str, learner_idx: str = "student_idx", item_idx: str = "problem_idx") -> DataFrame:
    """Train/valid drop masked or unknown rows; psychometric test keeps unknown items masked."""
    known_learner = F.col(learner_idx).isNotNull()
    if phase in FITTED:
        return df.where(F.col("metric_mask") & known_learner & F.col(item_idx).isNotNull())
    if phase == "test":
        return apply_oov_policy(df.where(known_learner), "irt", item_idx)
    raise ValueError(f"phase must be train, valid or test, got {phase!r}")


def execution_rows(df: DataFrame, family: str, tags: str = "tag_idxs") -> DataFrame:
    """Keep KC indexes for the families that use them, otherwise an empty list."""
    if family not in PSYCHOMETRIC + SEQUENCE:
        raise ValueError(f"unknown model family {family!r}")
    if family in ("ar_kt", "dkt_qc", "dkvmn_qc"):
        return df
    return df.withColumn(tags, F.array().cast("array<bigint>"))


def leaked_learners(fitted: DataFrame, test: DataFrame, column: str = "interaction_id") -> DataFrame:
    """Ids present both in fitting rows and in test rows; must be empty."""
    return fitted.select(column).intersect(test.select(column))


def missing_learners(cohort: DataFrame, seen: DataFrame, column: str = "learner_id") -> DataFrame:
    return cohort.select(column).exceptAll(seen.select(column).distinct())


def fitted_population(train: DataFrame, valid: DataFrame, column: str = "learner_id") -> DataFrame:
    return train.select(column).union(valid.select(column)).distinct()
