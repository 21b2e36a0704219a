"""One-row data-quality summaries built from mergeable aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.functions import scalars as S
from lumenseq.operators.layout import HotKeys, Running, hot_keys, scan
from lumenseq.operators.windows import _run_starts


def _hit(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def one_row(*parts: DataFrame) -> DataFrame:
    """Side-by-side one-row aggregates; every input is a global aggregate of one row."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def _sizes(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("bundle_count"),
        F.coalesce(F.min("_n"), F.lit(0)).alias("min_bundle_size"),
        F.coalesce(F.sum("_n") / F.count(F.lit(1)), F.lit(0.0)).alias("mean_bundle_size"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("max_bundle_size"),
    )


def bundle_sizes(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    return _sizes(df, key or ["learner_id", "bundle_id"])


def _kc_counts(df: DataFrame) -> DataFrame:
    repeated = S.repeats_kc(F.col("kc_ids"))
    rows = F.count(F.lit(1))
    rate = lambda c: F.coalesce(_hit(c) / F.nullif(rows, F.lit(0)), F.lit(0.0))
    return df.agg(
        rows.alias("eligible_rows"),
        _hit(repeated).alias("duplicate_kc_rows"),
        F.countDistinct(F.when(repeated, F.col("item_id"))).alias("duplicate_kc_questions"),
        _hit(F.size("kc_ids") > 1).alias("multi_kc_rows"),
        rate(F.size("kc_ids") > 1).alias("multi_kc_rate"),
        _hit(F.size("kc_ids") == 0).alias("missing_kc_rows"),
        rate(F.size("kc_ids") == 0).alias("missing_kc_rate"),
    )


def kt1_diagnostics(df: DataFrame, raw_rows: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Source irregularities of the eligible sequence; ``raw_rows`` has one row and column."""
    hot = hot_keys(df, ["learner_id"]) if hot is None else hot
    solving = S.solving_of_bundle(F.col("learner_id"), F.col("bundle_id"))
    steps = scan(
        df.select("learner_id", "order", "seq", "timestamp", solving.alias("_solving")),
        ["learner_id"], ["order", "seq"],
        [Running("_pts", "last", F.col("timestamp")), Running("_psolving", "last", F.col("_solving"))],
        hot,
    ).agg(
        _hit(F.col("timestamp") < F.col("_pts")).alias("timestamp_inversions"),
        _hit(F.col("_solving") < F.col("_psolving")).alias("solving_id_inversions"),
    )
    attempts = (
        df.groupBy("learner_id", "item_id")
        .agg(F.count(F.lit(1)).alias("_n"), (F.min("bundle_id") != F.max("bundle_id")).alias("_many"))
        .agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_question_attempt_rows"),
            _hit(F.col("_many")).alias("questions_repeated_across_bundles"),
        )
    )
    same_time = (
        df.where(F.col("timestamp").isNotNull()).groupBy("learner_id", "timestamp")
        .agg(F.count(F.lit(1)).alias("_n")).agg(_hit(F.col("_n") > 1).alias("duplicate_timestamp_groups"))
    )
    sizes = bundle_sizes(df).drop("mean_bundle_size")
    wide = one_row(raw_rows.toDF("raw_rows"), _kc_counts(df), steps, attempts, same_time, sizes)
    return wide.withColumn("filtered_rows", F.col("raw_rows") - F.col("eligible_rows"))


def sequence_invariants(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Reopened bundles, solving inversions at bundle changes, timestamp inversions."""
    hot = hot_keys(df, ["learner_id"]) if hot is None else hot
    narrow = df.select("learner_id", "order", "seq", "solving_id", "timestamp")
    started = _run_starts(narrow, "solving_id", False, hot, ["learner_id"], ["order", "seq"])
    seen = scan(
        started, ["learner_id"], ["order", "seq"],
        [Running("_psolving", "last", F.col("solving_id")), Running("_pts", "last", F.col("timestamp"))],
        hot,
    )
    start = F.col("run_start") == 1
    counts = seen.agg(
        _hit(start).alias("_runs"),
        _hit(start & (F.col("solving_id") < F.col("_psolving"))).alias("solving_id_inversions"),
        _hit(F.col("timestamp") < F.col("_pts")).alias("timestamp_inversions"),
    )
    bundles = narrow.select("learner_id", "solving_id").distinct().agg(F.count(F.lit(1)).alias("_bundles"))
    return one_row(counts, bundles).select(
        (F.col("_runs") - F.col("_bundles")).alias("noncontiguous_bundles"),
        "solving_id_inversions",
        "timestamp_inversions",
    )


def split_diagnostics(df: DataFrame, raw_rows: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Counts reported for a prepared KT1 dataset, including rows per split."""
    counts = df.agg(
        F.count(F.lit(1)).alias("eligible_rows"),
        F.countDistinct("learner_id").alias("learner_count"),
        F.countDistinct("item_id").alias("item_count"),
        *[_hit(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "valid", "test")],
    )
    kcs = df.select(F.explode("kc_ids").alias("kc")).agg(F.countDistinct("kc").alias("real_kc_count"))
    kc_rows = _kc_counts(df).select("missing_kc_rows", "multi_kc_rows", "duplicate_kc_rows")
    wide = one_row(raw_rows.toDF("raw_rows"), counts, kcs, kc_rows, _sizes(df, ["bundle_id"]), sequence_invariants(df, hot))
    return wide.withColumn("filtered_rows", F.col("raw_rows") - F.col("eligible_rows"))


def tutor_diagnostics(marked: DataFrame, closed: DataFrame, canonical: DataFrame,
                      students: DataFrame, items: DataFrame, skills: DataFrame) -> DataFrame:
    """Counters of the tutor log: drops, vocabulary sizes, closure and OOV rows."""
    reason = F.col("drop_reason")
    drops = marked.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        _hit(reason == "non_first_attempt").alias("filtered_non_first_attempt"),
        _hit(reason == "invalid_response").alias("invalid_response_rows"),
        _hit(reason == "missing_learner").alias("missing_learner_rows"),
        _hit(reason == "missing_item").alias("missing_item_rows"),
        _hit(reason == "missing_kc").alias("missing_kc_rows"),
    )
    split = F.col("split")
    rows = canonical.agg(
        F.count(F.lit(1)).alias("eligible_rows"),
        _hit(F.col("metric_mask")).alias("metric_eligible_rows"),
        _hit(~F.col("metric_mask")).alias("oov_rows"),
        _hit(F.size("kc_ids") > 1).alias("multi_kc_rows"),
        F.coalesce(_hit(F.size("kc_ids") > 1) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("multi_kc_rate"),
    )
    # Distinct counts are rolled up: one row per bundle with flags, one per student, one in all. Every row is aggregated once.
    splits = ("train", "valid", "test")
    bundles = closed.groupBy("student_id", "timestamp").agg(
        _hit(F.col("promoted")).alias("_promoted"),
        F.max(F.col("crossing").cast("int")).alias("_crossing"),
        *[_hit(split == s).alias(f"_{s}") for s in splits],
    )
    has = lambda s: (F.col(f"_{s}") > 0).cast("long")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    students_seen = bundles.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("_bundles"),
        F.sum("_promoted").alias("_promoted"),
        F.sum((F.col("_crossing") == 1).cast("long")).alias("_crossing"),
        F.sum(has("train") * has("valid")).alias("_derived"),
        *[F.sum(f"_{s}").alias(f"_{s}") for s in splits],
        *[F.sum(has(s)).alias(f"_{s}_bundles") for s in ("train", "valid")],
    )
    closure = students_seen.agg(
        F.count(F.lit(1)).alias("learners"),
        total("_bundles", "bundles"),
        *[total(f"_{s}", f"{s}_rows") for s in splits],
        *[total(f"_{s}_bundles", f"{s}_bundles") for s in ("train", "valid")],
        *[total(has(s), f"n_{s}_users") for s in ("train", "valid")],
        total("_promoted", "promoted_to_valid"),
        total("_crossing", "nominal_cross_boundary_bundles"),
        total("_derived", "derived_cross_boundary_bundles"),
    )
    items_seen = closed.agg(F.countDistinct("problem_id").alias("items"))
    skills_seen = closed.agg(F.countDistinct("skill_id").alias("kcs"))
    size = lambda v, n: v.agg(F.count(F.lit(1)).alias(n))
    wide = one_row(drops, rows, closure, items_seen, skills_seen, size(students, "n_students_vocab"),
                   size(items, "n_questions_vocab"), size(skills, "n_skills_vocab"))
    return wide.withColumn("n_questions_full", F.col("items")).withColumn("n_skills_full", F.col("kcs"))


def split_counts(df: DataFrame) -> DataFrame:
    """Rows and learners per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("learner_id").alias("learners"))


def prediction_targets(df: DataFrame) -> DataFrame:
    """One target per interaction, whatever its KC count."""
    return df.agg(F.count(F.lit(1)).alias("targets"))
