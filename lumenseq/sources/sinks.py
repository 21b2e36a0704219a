"""Writers for prepared datasets, predictions, model state and manifests."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseq.operators.models import B_LR, ETA_R, L2, THETA_LR
from lumenseq.sources.files import SourceError, read_text

STATE_FORMAT = "learner_state_tables_v1"
PREPARED_COLUMNS = (
    "interaction_id", "learner_id", "item_id", "correct", "kc_ids", "order", "timestamp", "bundle_id", "split", "metric_mask",
)
# The columns of a prediction table, in order.
PREDICTION_COLUMNS = (
    "interaction_id", "learner_id", "item_id", "bundle_id", "order", "split", "correct", "probability", "metric_mask",
    "model", "seed", "kc_ids",
)


def write_splits(df: DataFrame, path: str, extra: tuple[str, ...] = ("source_row", "solving_id"), mode: str = "errorifexists") -> None:
    """Prepared dataset, one directory per split, rows in ``seq`` order inside files.

    Range partitioning by (split, seq) keeps file sizes even when one learner or
    one split dominates, and makes file-level min/max statistics on seq useful.
    """
    columns = ["seq", *PREPARED_COLUMNS, *[c for c in extra if c in df.columns]]
    ordered = df.select(*columns).repartitionByRange("split", "seq").sortWithinPartitions("split", "seq")
    ordered.write.mode(mode).partitionBy("split").parquet(path)


def write_predictions(scored: DataFrame, path: str, model: str, seed: int, mode: str = "errorifexists") -> None:
    """Scored rows with the model's name and seed; rows keep their ``seq`` as well."""
    tagged = scored.withColumns({"model": F.lit(model), "seed": F.lit(seed).cast("long")}).select("seq", *PREDICTION_COLUMNS)
    tagged.write.mode(mode).parquet(path)


def write_roles(df: DataFrame, path: str, roles: list[tuple[str, str]], mode: str = "errorifexists") -> None:
    """One directory per role, so a TRAIN/VALID reader cannot open TEST files."""
    role = F.lit(None).cast("string")
    for split_id, name in roles:
        role = F.when(F.col("split") == split_id, name).otherwise(role)
    labelled = df.withColumn("role", role)
    stray = F.when(F.col("role").isNull(), F.raise_error(F.concat(F.lit("undeclared split "), F.coalesce("split", F.lit("null")))).cast("string")).otherwise(F.col("role"))
    labelled.withColumn("role", stray).repartitionByRange("role", "seq").sortWithinPartitions("role", "seq").write.mode(mode).partitionBy("role").parquet(path)


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """A small sidecar document through the Hadoop file system."""
    fs, target = _fs(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(json.dumps(document, ensure_ascii=False, sort_keys=True, indent=1).encode("utf-8")))
    stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def write_manifest(spark: SparkSession, path: str, identity: dict, *summaries: DataFrame, dropped: DataFrame | None = None) -> dict:
    """Identity plus one-row summaries, collected as counters only, and dropped rows per reason (``reason, n``)."""
    document = {"identity": identity}
    if dropped is not None:
        document["dropped"] = {r["reason"]: r["n"] for r in dropped.collect()}  # a row per rule
    for frame in summaries:
        rows = frame.limit(2).collect()
        if len(rows) != 1:
            raise SourceError("a manifest summary must be one row")
        document.update(rows[0].asDict())
    write_json(spark, path, document)
    return document


def publish_if_changed(spark: SparkSession, destination: str, identity: dict, write: Callable[[str], None], rebuild: bool = False) -> str:
    """Publish a directory once: ``prepared``, ``reused`` or an error when identities differ.

    The data is written to a sibling path first and renamed, so a reader never
    sees a half-written dataset and a lost job leaves the old one in place.
    """
    sidecar = f"{destination}/identity.json"
    if exists(spark, destination):
        stored = read_json(spark, sidecar) if exists(spark, sidecar) else None
        if stored == identity and not rebuild:
            return "reused"
        if not rebuild:
            raise SourceError(f"{destination} holds another dataset; pass rebuild=True to replace it")
    staging, retired = f"{destination}.staging", f"{destination}.previous"
    fs, target = _fs(spark, destination)
    for leftover in (staging, retired):
        if exists(spark, leftover):
            fs.delete(_fs(spark, leftover)[1], True)
    write(staging)
    write_json(spark, f"{staging}/identity.json", identity)
    if exists(spark, destination):
        fs.rename(target, _fs(spark, retired)[1])
    fs.rename(_fs(spark, staging)[1], target)
    if exists(spark, retired):
        fs.delete(_fs(spark, retired)[1], True)
    return "prepared"


def save_state(states: DataFrame, difficulty: DataFrame, path: str, model_kind: str, rule: str = "token", eta: float = ETA_R,
               theta_lr: float = THETA_LR, b_lr: float = B_LR, l2: float = L2) -> None:
    """Ability, difficulty and residual tables plus a one-row header with the rule and rates of the training."""
    if model_kind not in ("irt", "ar_kt"):
        raise SourceError(f"no state format for model {model_kind!r}: irt and ar_kt have one")
    spark = states.sparkSession
    states.where("slot < 0").select("learner_id", F.col("values")[0].alias("theta")).write.parquet(f"{path}/theta")
    difficulty.select("item_id", "b").write.parquet(f"{path}/b")
    states.where("slot >= 0").select(
        "learner_id", F.col("slot").alias("kc"), F.col("values")[0].alias("r"), F.lit(True).alias("seen"),
        F.col("clock").alias("last_ts")).write.parquet(f"{path}/resid")
    header = dict(format_id=STATE_FORMAT, model_kind=model_kind, rule=rule, eta=eta, theta_lr=theta_lr, b_lr=b_lr, l2=l2)
    write_json(spark, f"{path}/header.json", header)


def load_state(spark: SparkSession, path: str, model_kind: str) -> tuple[dict, DataFrame, DataFrame]:
    """Header, learner state records and difficulty table; kind and format are checked."""
    header = read_json(spark, f"{path}/header.json")
    if header.get("format_id") != STATE_FORMAT:
        raise SourceError(f"unknown state format {header.get('format_id')!r}")
    if header.get("model_kind") != model_kind:
        raise SourceError(f"state is for {header.get('model_kind')!r}, not {model_kind!r}")
    theta = spark.read.parquet(f"{path}/theta").select(
        "learner_id", F.lit(-1).cast("long").alias("slot"), F.array("theta").alias("values"),
        F.lit(None).cast("long").alias("clock"), F.lit(None).cast("binary").alias("blob"))
    resid = spark.read.parquet(f"{path}/resid").select(
        "learner_id", F.col("kc").alias("slot"), F.array(F.col("r"), F.lit(0.0)).alias("values"),
        F.col("last_ts").alias("clock"), F.lit(None).cast("binary").alias("blob"))
    return header, theta.unionByName(resid), spark.read.parquet(f"{path}/b")
