"""Row types of the canonical interaction table."""

from __future__ import annotations

from pyspark.sql import types as T

CANONICAL_FIELDS = (
    "interaction_id",
    "learner_id",
    "item_id",
    "correct",
    "kc_ids",
    "order",
    "timestamp",
    "bundle_id",
    "split",
    "metric_mask",
)


def canonical_schema(timestamp: T.DataType | None = None) -> T.StructType:
    """The ten canonical fields plus ``seq``, the explicit row order."""
    return T.StructType(
        [
            T.StructField("seq", T.LongType(), False),
            T.StructField("interaction_id", T.StringType(), False),
            T.StructField("learner_id", T.StringType(), False),
            T.StructField("item_id", T.StringType(), False),
            T.StructField("correct", T.LongType(), False),
            T.StructField("kc_ids", T.ArrayType(T.LongType(), False), False),
            T.StructField("order", T.LongType(), False),
            T.StructField("timestamp", timestamp or T.DoubleType(), True),
            T.StructField("bundle_id", T.StringType(), False),
            T.StructField("split", T.StringType(), True),
            T.StructField("metric_mask", T.BooleanType(), False),
        ]
    )
