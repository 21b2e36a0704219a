"""Session settings the operators read: checkpoint folder and hot-key threshold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_SETTING = "spark.lumenseq.hotKeyRows"
HOT_ROWS_DEFAULT = 2_000_000
HOT_KEY_LIMIT = 4096


def hot_key_rows(spark: SparkSession) -> int:
    """Rows one key may hold before its work is split over several tasks."""
    return int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS_DEFAULT)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; pick one only in local mode, where all is one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))  # one machine: its own folder is shared


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new name inside the shared checkpoint folder, which outlives any executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it back.

    A written table is computed once, is columnar, and later reads take only the
    columns they need; a reliable RDD checkpoint would compute the rows twice.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
