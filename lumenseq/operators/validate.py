"""Dataset checks; every check is a DataFrame of issues, empty when the data is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.functions import scalars as S
from lumenseq.operators.layout import HotKeys, Running, scan
from lumenseq.operators.windows import _run_starts, later_duplicates

ISSUE_COLUMNS = ("code", "learner_id", "key", "interaction_id", "message")


def _issue(code: str, when: Column, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message")))


def row_issues(df: DataFrame) -> DataFrame:
    """All row-local checks in one pass: blank ids, ranges, negative KCs, NaN times."""
    checks = [
        _issue("empty_learner_id", S.is_blank(F.col("learner_id")), F.lit("learner_id is empty")),
        _issue("empty_item_id", S.is_blank(F.col("item_id")), F.lit("item_id is empty")),
        _issue("empty_interaction_id", S.is_blank(F.col("interaction_id")), F.lit("interaction_id is empty")),
        _issue("empty_bundle_id", S.is_blank(F.col("bundle_id")), F.lit("bundle_id is empty")),
        _issue("invalid_correct", ~F.col("correct").isin(0, 1),
               F.concat(F.lit("correct must be 0 or 1, got "), F.col("correct").cast("string"))),
        _issue("invalid_order", F.col("order") < 0,
               F.concat(F.lit("order must be >= 0, got "), F.col("order").cast("string"))),
        _issue("empty_split", F.col("split").isNotNull() & S.is_blank(F.col("split")), F.lit("split is an empty string")),
        _issue("invalid_timestamp", F.coalesce(F.isnan(F.col("timestamp").cast("double")), F.lit(False)), F.lit("timestamp is NaN")),
    ]
    negative = F.transform(
        F.filter("kc_ids", lambda k: k < 0),
        lambda k: F.struct(F.lit("invalid_kc_id").alias("code"),
                           F.concat(F.lit("kc_ids contains a negative id "), k.cast("string")).alias("message")),
    )
    found = F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), negative)
    return df.select("learner_id", "interaction_id", F.explode(found).alias("_i")).select(
        F.col("_i.code").alias("code"), "learner_id", F.lit(None).cast("string").alias("key"),
        "interaction_id", F.col("_i.message").alias("message"),
    )


def _shape(df: DataFrame, code: str, key: Column, message: Column,
           learner: Column | None = None, interaction: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(code).alias("code"),
        (learner if learner is not None else none).alias("learner_id"),
        key.cast("string").alias("key"),
        (interaction if interaction is not None else none).alias("interaction_id"),
        message.alias("message"),
    )


def duplicate_interaction_ids(df: DataFrame) -> DataFrame:
    counted = df.groupBy("interaction_id").agg(F.count(F.lit(1)).alias("_n"))
    bad = counted.where((F.col("_n") > 1) & ~S.is_blank(F.col("interaction_id")))
    message = F.concat(F.lit("interaction_id appears "), F.col("_n").cast("string"), F.lit(" times"))
    return _shape(bad, "duplicate_interaction_id", F.col("interaction_id"), message, interaction=F.col("interaction_id"))


def duplicate_learner_orders(df: DataFrame) -> DataFrame:
    bad = later_duplicates(df, ["learner_id", "order"])
    message = F.concat(F.lit("order "), F.col("order").cast("string"), F.lit(" repeats inside the learner"))
    return _shape(bad, "duplicate_learner_order", F.col("order"), message, F.col("learner_id"), F.col("interaction_id"))


def _bundle_sets(df: DataFrame) -> DataFrame:
    """Learner and split cardinality of every bundle; a null split is a value.

    min/max comparison decides "more than one" without collecting the sets.
    """
    named = F.when(F.col("split").isNotNull(), F.struct(F.lit(1).alias("f"), F.col("split").alias("s"))).otherwise(
        F.struct(F.lit(0).alias("f"), F.lit("").alias("s"))
    )
    return df.where(~S.is_blank(F.col("bundle_id"))).groupBy("bundle_id").agg(
        (F.min("learner_id") != F.max("learner_id")).alias("many_learners"),
        (F.min(named) != F.max(named)).alias("many_splits"),
    )


def bundle_issues(df: DataFrame) -> DataFrame:
    """Bundles shared by several learners or several splits."""
    checks = F.array(
        _issue("bundle_crosses_learner", F.col("many_learners"), F.lit("bundle spans several learners")),
        _issue("bundle_crosses_split", F.col("many_splits"), F.lit("bundle spans several splits")),
    )
    found = _bundle_sets(df).select("bundle_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("_i"))
    none = F.lit(None).cast("string")
    return found.select(F.col("_i.code").alias("code"), none.alias("learner_id"), F.col("bundle_id").alias("key"),
                        none.alias("interaction_id"), F.col("_i.message").alias("message"))


def contiguity_issues(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Bundles reopened after another bundle, in ``order`` sequence of the learner."""
    started = _run_starts(df, "bundle_id", False, hot, ["learner_id"], ["order", "seq"])
    starts = started.where("run_start = 1").withColumn("_at", F.struct("order", "seq"))
    first = starts.groupBy("learner_id", "bundle_id").agg(F.min("_at").alias("_first"))
    bad = starts.join(first, ["learner_id", "bundle_id"]).where(F.col("_at") > F.col("_first"))
    message = F.concat(F.lit("bundle is revisited at order "), F.col("order").cast("string"))
    return _shape(bad, "bundle_not_contiguous", F.col("bundle_id"), message, F.col("learner_id"), F.col("interaction_id"))


def temporal_issues(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Timestamps below the last known earlier timestamp; equal is allowed."""
    ts = F.col("timestamp").cast("double")
    usable = F.when(ts.isNotNull() & ~F.isnan(ts), ts)
    seen = scan(df, ["learner_id"], ["order", "seq"], [Running("_prev", "last", usable)], hot)
    bad = seen.where(usable < F.col("_prev"))
    message = F.concat(F.lit("timestamp goes back at order "), F.col("order").cast("string"))
    return _shape(bad, "temporal_regression", F.col("order"), message, F.col("learner_id"), F.col("interaction_id"))


def validate(df: DataFrame, check_temporal: bool = True, check_bundle_contiguity: bool = True,
             hot: HotKeys | None = None) -> DataFrame:
    parts = [row_issues(df), duplicate_interaction_ids(df), duplicate_learner_orders(df), bundle_issues(df)]
    if check_bundle_contiguity:
        parts.append(contiguity_issues(df, hot))
    if check_temporal:
        parts.append(temporal_issues(df, hot))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def is_valid(df: DataFrame, **options) -> bool:
    return validate(df, **options).isEmpty()


def repeated_kc_report(df: DataFrame) -> DataFrame:
    """Rows whose KC list repeats a value; informational, not part of validity."""
    bad = df.where(S.repeats_kc(F.col("kc_ids")))
    listed = F.array_join(F.transform("kc_ids", lambda k: k.cast("string")), ",")
    return _shape(bad, "duplicate_kc_id", listed, F.concat(F.lit("kc_ids repeats a token: "), listed),
                  F.col("learner_id"), F.col("interaction_id"))


def count_gate(observed: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Counters of a one-row DataFrame that differ from the recorded protocol values."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("counter"), F.col(n).cast("long").alias("observed"), F.lit(v).cast("long").alias("expected"))
        for n, v in expected.items()
    ])
    rows = observed.select(F.explode(pairs).alias("_p")).select("_p.*")
    return rows.where(~F.col("observed").eqNullSafe(F.col("expected")))
