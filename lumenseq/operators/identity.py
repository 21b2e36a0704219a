"""Content identity: canonical row text, order-sensitive hashes and evidence."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenseq.operators.layout import HotKeys, Running, scan

# Version labels that enter the hashed documents.
CONTRACT_IDENTITY_VERSION = "dataset_contract_identity_v1"
DATASET_IDENTITY_VERSION = "dataset_logical_identity_v1"
SERIALIZATION_VERSION = "canonical_interaction_hash_v1"
METRIC_EVIDENCE_VERSION = "external_valid_metric_evidence_v1"

EXACT_INTEGER_LIMIT = 2**53
TREE_FANOUT = 8192
_UPPER_HEX_CONTROLS = (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F)


def json_text(column: Column) -> Column:
    """JSON string literal: UTF-8 kept, control characters in lower-case hex."""
    packed = F.to_json(F.array(column))
    text = F.substring(packed, 2, F.length(packed) - 2)
    fixed = text
    for code in _UPPER_HEX_CONTROLS:
        # An even number of backslashes before the escape means it is a real one.
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    has = column.rlike("[\\x0b\\x0e\\x0f\\x1a-\\x1f]")
    return F.when(has, fixed).otherwise(text)


@F.pandas_udf(T.StringType())
def _scientific(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else format(v, ".16e"))


def number_token(column: Column, kind: T.DataType) -> Column:
    """Decimal integers, else scientific notation with 17 significant digits.

    Integer columns never leave the JVM. For doubles only the fractional values
    need Python's digit generation. NaN and infinities fail the query.
    """
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.cast("string")
    bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    whole = (F.floor(column) == column) & (F.abs(column) <= EXACT_INTEGER_LIMIT)
    fraction = F.when(~bad & ~whole, column)
    return (
        F.when(bad, F.raise_error(F.lit("number must be finite")).cast("string"))
        .when(whole, column.cast("long").cast("string"))
        .otherwise(_scientific(fraction))
    )


def probability_token(column: Column) -> Column:
    outside = (column < 0.0) | (column > 1.0)
    checked = F.when(outside, F.raise_error(F.lit("probability outside [0, 1]")).cast("double")).otherwise(column)
    return number_token(checked, T.DoubleType())


def row_json(df: DataFrame) -> Column:
    """Compact JSON of the ten canonical fields in fixed order."""
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda name: field(name, json_text(F.col(name)))
    whole = lambda name: field(name, F.col(name).cast("string"))
    kcs = F.concat(F.lit("["), F.array_join(F.transform("kc_ids", lambda k: k.cast("string")), ","), F.lit("]"))
    when = number_token(F.col("timestamp"), df.schema["timestamp"].dataType)
    parts = [
        text("interaction_id"), text("learner_id"), text("item_id"), whole("correct"), field("kc_ids", kcs),
        whole("order"), field("timestamp", F.coalesce(when, F.lit("null"))), text("bundle_id"),
        field("split", F.coalesce(json_text(F.col("split")), F.lit("null"))),
        field("metric_mask", F.when(F.col("metric_mask"), "true").otherwise("false")),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def provenance_line(df: DataFrame) -> Column:
    parts = ["learner_id", "source_row", "item_id", "solving_id", "timestamp", "split"]
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])


def trace_line() -> Column:
    return F.concat(F.lit('{"interaction_id":'), json_text(F.col("interaction_id")), F.lit(',"probability":'),
                    probability_token(F.col("probability")), F.lit("}"))


def tree_leaves(df: DataFrame, line: Column, group: str, order: str = "seq", hot: HotKeys | None = None, fanout: int = TREE_FANOUT) -> DataFrame:
    """Lowest level of the hash tree: a hash, a row count and the span of ``order`` for each ``fanout`` lines of a group.

    Lines are numbered inside the group; no task sees more than ``fanout`` lines of one group at once. Stored beside the
    data, the leaves prove a part of it without the rest, and tell where it differs.
    """
    numbered = scan(df.select(group, order, line.alias("_line")), [group], order, [Running("_at", "count")], hot)
    level = numbered.select(F.col(group), F.col(order), F.col("_at").cast("long").alias("_at"), F.col("_line").alias("_h"))
    leaves = level.groupBy(group, F.floor(F.col("_at") / F.lit(fanout)).cast("long").alias("leaf")).agg(
        _packed(), F.count(F.lit(1)).alias("row_count"), F.min(order).alias("first_seq"), F.max(order).alias("last_seq"))
    return leaves.withColumnRenamed("_h", "leaf_hash")


def tree_roots(leaves: DataFrame, group: str) -> DataFrame:
    """Hash and row count of each group from its leaves: one more level of blocks, then the top."""
    level = leaves.select(F.col(group), F.col("leaf").alias("_at"), F.col("leaf_hash").alias("_h"), F.col("row_count").alias("_n"))
    block = F.floor(F.col("_at") / F.lit(TREE_FANOUT)).cast("long")
    level = level.groupBy(group, block.alias("_b")).agg(_packed(), F.sum("_n").alias("_n")).withColumnRenamed("_b", "_at")
    return level.groupBy(group).agg(_packed(), F.sum("_n").alias("_n")).select(
        group, F.col("_h").alias("tree_hash"), F.col("_n").alias("row_count"))


def tree_hash(df: DataFrame, line: Column, group: str, order: str = "seq", hot: HotKeys | None = None) -> DataFrame:
    """Order-sensitive hash per group as a fixed three-level tree of SHA-256; any edit, drop or swap changes it."""
    return tree_roots(tree_leaves(df, line, group, order, hot), group)


def damaged_leaves(stored: DataFrame, observed: DataFrame, group: str) -> DataFrame:
    """Leaves whose stored and observed hash differ, or that exist on one side only, with their spans."""
    a = stored.select(group, "leaf", F.col("leaf_hash").alias("_sh"), F.col("row_count").alias("stored_rows"), F.col("first_seq").alias("_sf"), F.col("last_seq").alias("_sl"))
    b = observed.select(group, "leaf", F.col("leaf_hash").alias("_oh"), F.col("row_count").alias("observed_rows"), F.col("first_seq").alias("_of"), F.col("last_seq").alias("_ol"))
    return a.join(b, [group, "leaf"], "full").where(~F.col("_sh").eqNullSafe(F.col("_oh"))).select(
        group, "leaf", F.coalesce("_sf", "_of").alias("first_seq"), F.coalesce("_sl", "_ol").alias("last_seq"), "stored_rows", "observed_rows")


def _packed() -> Column:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_h"))), lambda x: x["_h"])
    return F.sha2(F.concat_ws("\n", ordered), 256).alias("_h")


def _document(pairs: Sequence[tuple[str, object]]) -> str:
    return json.dumps(dict(pairs), ensure_ascii=False, separators=(",", ":"))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def dataset_identity(dataset_id: str, protocol_id: str, preprocessing_version: str, cohort_hash: str | None,
                     splits: Sequence[tuple[str, str, int]], item_hash: str | None, kc_hash: str | None) -> tuple[str, str]:
    """Identity document of a prepared dataset and its SHA-256; a few strings only."""
    rows = [dict(split_id=s, logical_hash=h, row_count=int(n)) for s, h, n in splits]
    text = _document([
        ("identity_version", DATASET_IDENTITY_VERSION), ("serialization_version", SERIALIZATION_VERSION),
        ("dataset_id", dataset_id), ("protocol_id", protocol_id), ("preprocessing_version", preprocessing_version),
        ("cohort_hash", cohort_hash), ("splits", rows), ("item_vocabulary_hash", item_hash), ("kc_vocabulary_hash", kc_hash),
    ])
    return text, _digest(text)


def contract_identity(logical_hash: str, schema_version: str, bundle_semantics: str, oov_semantics: str,
                      mask_semantics: str, roles: Sequence[tuple[str, str]]) -> tuple[str, str]:
    """Contract document: logical hash plus the declared semantics and split roles."""
    text = _document([
        ("contract_identity_version", CONTRACT_IDENTITY_VERSION), ("dataset_logical_hash", logical_hash),
        ("canonical_schema_version", schema_version), ("bundle_semantics_id", bundle_semantics),
        ("oov_representation_semantics_id", oov_semantics), ("metric_mask_semantics", mask_semantics),
        ("split_roles", [dict(split_id=s, role=r) for s, r in roles]),
    ])
    return text, _digest(text)


def metric_evidence(metrics: DataFrame) -> DataFrame:
    """One-row metrics to canonical evidence text and hash; undefined values are null."""
    def token(name):
        value = F.col(name).cast("double")
        usable = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        return F.concat(F.lit(f'"{name}":'), F.coalesce(number_token(usable, T.DoubleType()), F.lit("null")))

    text = F.concat(
        F.lit('{"evidence_version":"' + METRIC_EVIDENCE_VERSION + '",'),
        F.concat_ws(",", token("nll"), token("brier"), token("auc"), F.concat(F.lit('"n":'), F.col("n").cast("string"))),
        F.lit("}"),
    )
    return metrics.select(text.alias("evidence")).withColumn("evidence_hash", F.sha2("evidence", 256))


def identity_mismatches(stored: DataFrame, observed: DataFrame, group: str = "split") -> DataFrame:
    """Splits whose stored and observed hash or count differ, or that exist on one side only."""
    a = stored.select(group, F.col("tree_hash").alias("stored_hash"), F.col("row_count").alias("stored_rows"))
    b = observed.select(group, F.col("tree_hash").alias("observed_hash"), F.col("row_count").alias("observed_rows"))
    same = F.col("stored_hash").eqNullSafe(F.col("observed_hash")) & F.col("stored_rows").eqNullSafe(F.col("observed_rows"))
    return a.join(b, group, "full").where(~same)
