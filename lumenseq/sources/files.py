"""Readers for raw logs and canonical directories; schemas are explicit, never inferred."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenseq.functions.scalars import is_kc_token
from lumenseq.operators.cleaning import question_catalog
from lumenseq.operators.splits import split_roles
from lumenseq.schema import CANONICAL_FIELDS, canonical_schema

# Required CSV columns, declaration keys and schema labels.
KT1_USER_COLUMNS = ("timestamp", "solving_id", "question_id", "user_answer")
KT1_COLUMNS = ("user_id", *KT1_USER_COLUMNS)
TUTOR_COLUMNS = ("student_id", "problem_id", "skill_id", "correct", "timestamp", "attempt_count")
DECLARATION_REQUIRED = (
    "dataset_id", "protocol_id", "preprocessing_version", "canonical_schema_version", "interaction_identity_version",
    "dataset_identity_version", "split_order", "split_roles", "bundle_semantics_id", "oov_representation_semantics_id",
    "metric_mask_semantics", "provenance",
)
DECLARATION_OPTIONAL = ("source_fingerprint",)
DECLARATION_VERSIONS = {
    "canonical_schema_version": "canonical_interaction_schema_v1",
    "interaction_identity_version": "canonical_interaction_hash_v1",
    "dataset_identity_version": "dataset_logical_identity_v1",
}


#: Up to so many files are named in a scan, which then opens no others; beyond it all are read and joined with the list.
NAMED_FILES = 10_000


class SourceError(ValueError):
    """An input file breaks the format it declares."""


def _text(spark: SparkSession, path: str, glob: str | None, names: Sequence[str] | None) -> DataFrame:
    """Text lines; with ``names`` only files of these names are listed for the scan."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    lines = reader.text(path)
    return lines if names is None else lines.where(F.col("_metadata.file_name").isin(list(names)))


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None, skip_blank: bool = False,
                   names: Sequence[str] | None = None) -> DataFrame:
    """Lines with ``file`` and 0-based ``line`` inside the file, without a shuffle.

    A line's place in its file block comes from the scan order; block starts are
    ordered by their byte offset. Only one row per file block is aggregated.
    """
    lines = _text(spark, path, glob, names).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")
    )
    if skip_blank:
        lines = lines.where(F.col("value") != "")
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return lines.join(starts, ["file", "_block"]).select(
        "file", (F.col("_start") + F.col("_id") - F.col("_first")).alias("line"), "value"
    )


def csv_rows(spark: SparkSession, path: str, required: tuple[str, ...], glob: str | None = None,
             names: Sequence[str] | None = None) -> DataFrame:
    """CSV records as text columns plus ``file`` and the 0-based data row ``source_row``.

    All files share one header: it is read from the start of one file, and the scan
    that reads the rows holds every other file's header against it. Records with a
    line break inside quotes are refused because the reader is line based.
    """
    top = _text(spark, path, glob, names).where((F.col("_metadata.file_block_start") == 0) & (F.col("value") != "")).first()
    if top is None:
        raise SourceError(f"{path}: CSV has no header")
    header = top["value"]
    columns = [h.strip() for h in next(csv.reader([header]))]
    missing = [c for c in required if c not in columns]
    if missing:
        raise SourceError(f"{path}: CSV lacks columns {missing}; got {columns}")
    lines = numbered_lines(spark, path, glob, skip_blank=True, names=names)
    other = F.raise_error(F.concat(F.col("file"), F.lit(" has another header: "), F.col("value"))).cast("boolean")
    lines = lines.where(F.when(F.col("line") > 0, F.lit(True)).when(F.col("value") == header, F.lit(False)).otherwise(other))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    body = lines.withColumn(
        "value",
        F.when(quotes % 2 == 1, F.raise_error(F.concat(F.lit("quoted line break at line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))).cast("string"))
        .otherwise(F.col("value")),
    )
    schema = ", ".join(f"`{n}` string" for n in columns)
    parsed = body.select("file", (F.col("line") - 1).alias("source_row"), F.from_csv("value", schema, {"mode": "PERMISSIVE"}).alias("_r"))
    return parsed.select("file", "source_row", *[F.col("_r")[c].alias(c) for c in required],
                         *[F.col("_r")[c].alias(c) for c in columns if c not in required])


def read_kt1_user_dir(spark: SparkSession, path: str, learners: DataFrame | None = None) -> DataFrame:
    """One CSV per learner; the learner id is the file stem, ``source_row`` its row index.

    With ``learners`` (``user_id``) only their rows: up to NAMED_FILES of them are named in the scan, so other files are not opened.
    """
    names = None
    if learners is not None:
        some = learners.select("user_id").limit(NAMED_FILES + 1).collect()
        names = [f"{r[0]}.csv" for r in some] if len(some) <= NAMED_FILES else None
    rows = csv_rows(spark, path, KT1_USER_COLUMNS, glob="u*.csv", names=names)
    stem = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    rows = rows.select(stem.alias("user_id"), "source_row", *KT1_USER_COLUMNS)
    return rows if learners is None or names is not None else rows.join(learners.select("user_id"), "user_id", "left_semi")


def kt1_user_ids(spark: SparkSession, path: str) -> DataFrame:
    """Learner ids of a per-learner directory from file names only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "u*.csv").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("user_id"))


def read_kt1_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = csv_rows(spark, path, KT1_COLUMNS)
    return rows.select(*KT1_COLUMNS, "source_row", F.col("source_row").alias("seq"))


def read_tutor_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows(spark, path, TUTOR_COLUMNS).select(*TUTOR_COLUMNS, "source_row")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Typed item catalog; an empty or repeated question id is an error."""
    catalog = question_catalog(csv_rows(spark, path, ("question_id", "tags")))
    # The arity is read so that an invalid tag cell fails here, not at first use.
    checked = catalog.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("kc_ids")).alias("arity"))
    bad = checked.where("n > 1 OR question_id = '' OR arity < 0").limit(1).collect()
    if bad:
        raise SourceError(f"question_id {bad[0][0]!r} is empty or repeated")
    return catalog


def read_ordered_ids(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary file: the line number is the index; blank or repeated ids are errors."""
    ids = numbered_lines(spark, path).select(F.col("line").alias("idx"), F.col("value").alias("id"))
    bad = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id = ''").limit(1).collect()
    if bad:
        raise SourceError(f"{path}: id {bad[0][0]!r} is blank or repeated")
    return ids


def canonical_from_lines(lines: DataFrame) -> DataFrame:
    """JSON lines (``line``, ``value``) to canonical rows; any format error names the line."""
    fields = [f for f in canonical_schema().fields if f.name != "seq"]
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    keys = F.json_object_keys("value")
    known = F.array(*[F.lit(c) for c in CANONICAL_FIELDS])
    row = F.from_json("value", loose, {"mode": "PERMISSIVE"})
    raw = lambda name: F.get_json_object("value", f"$.{name}")
    parsed = F.try_parse_json("value")
    wrong_type = F.lit(False)
    for f in fields:
        absent = F.col(f"_r.{f.name}").isNull()
        nullable = f.name in ("timestamp", "split")
        wrong_type = wrong_type | (absent & raw(f.name).isNotNull() if nullable else absent)
        if isinstance(f.dataType, T.StringType):  # from_json turns any JSON value into text; the variant knows what it was
            kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{f.name}", "variant"))
            wrong_type = wrong_type | ~F.coalesce(kind.isin("STRING", *(["VOID"] if nullable else [])), F.lit(nullable))
    problem = (
        F.when(F.col("value") == "", "is blank")
        .when(keys.isNull(), "is not one JSON object")
        .when(F.size(F.array_except(keys, known)) > 0, "has unknown fields")
        .when(F.size(F.array_except(known, keys)) > 0, "lacks fields")
        .when(wrong_type | F.exists(F.coalesce("_r.kc_ids", F.array().cast("array<bigint>")), lambda k: k.isNull()), "has a field of the wrong type")
    )
    failed = F.raise_error(F.concat(F.lit("line "), (F.col("line") + 1).cast("string"), F.lit(" "), F.col("_p")))
    checked = lines.withColumn("_r", row).withColumn("_p", problem)
    seq = F.when(F.col("_p").isNull(), F.col("line")).otherwise(failed.cast("long"))
    return checked.select(seq.cast("long").alias("seq"), *[F.col(f"_r.{c}").alias(c) for c in CANONICAL_FIELDS])


def read_canonical(spark: SparkSession, directory: str, name: str = "interactions.jsonl") -> DataFrame:
    """Canonical interactions of a dataset directory in stored line order."""
    return canonical_from_lines(numbered_lines(spark, f"{directory}/{name}"))


def read_kc_ids(spark: SparkSession, path: str) -> DataFrame:
    """KC vocabulary file: like any id file, and every id a canonical decimal integer."""
    ids = read_ordered_ids(spark, path)
    bad = ids.where(~is_kc_token(F.col("id"))).limit(1).collect()
    if bad:
        raise SourceError(f"{path}: kc id {bad[0]['id']!r} is not a canonical decimal integer")
    return ids


@dataclass
class CanonicalDirectory:
    """A canonical directory: declaration, rows in stored order, id tables ``(idx, id)`` in file order."""

    declared: dict
    rows: DataFrame
    learners: DataFrame
    items: DataFrame
    kcs: DataFrame


def read_directory(spark: SparkSession, directory: str) -> CanonicalDirectory:
    """All files of a canonical directory; each is required and checked by its own reader."""
    return CanonicalDirectory(
        read_declaration(spark, directory), read_canonical(spark, directory), read_ordered_ids(spark, f"{directory}/learner_ids.txt"),
        read_ordered_ids(spark, f"{directory}/item_ids.txt"), read_kc_ids(spark, f"{directory}/kc_ids.txt"))


def read_role(spark: SparkSession, directory: str, role: str) -> DataFrame:
    """Rows of one role; other roles' files are pruned and never opened."""
    rows = spark.read.parquet(directory).where(F.col("role") == role)
    return rows.drop("role")


def read_prepared(spark: SparkSession, directory: str, split: str, columns: list[str] | None = None) -> DataFrame:
    """Column-pruned scan of one split of a prepared dataset."""
    if split not in ("train", "valid", "test"):
        raise SourceError(f"unknown split {split!r}")
    rows = spark.read.parquet(directory)
    absent = [c for c in (columns or []) if c not in rows.columns]
    if absent:
        raise SourceError(f"{directory}: missing columns {absent}")
    foreign = rows.select("split").distinct().where(~F.col("split").isin("train", "valid", "test") | F.col("split").isNull()).limit(1).collect()
    if foreign:
        raise SourceError(f"{directory}: foreign split {foreign[0][0]!r}")
    chosen = rows.where(F.col("split") == split)
    return chosen.select(*columns) if columns else chosen


def read_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col(column).cast("string").alias(column))


def hash_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of every raw file, read in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def read_text(spark: SparkSession, path: str) -> str:
    """A small configuration file from any Hadoop file system."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_declaration(spark: SparkSession, directory: str, name: str = "declaration.json") -> dict:
    """Declared versions, split order and roles, checked before any data is scanned."""
    payload = json.loads(read_text(spark, f"{directory}/{name}"))
    if not isinstance(payload, dict):
        raise SourceError("declaration must be a JSON object")
    unknown = set(payload) - set(DECLARATION_REQUIRED) - set(DECLARATION_OPTIONAL)
    missing = set(DECLARATION_REQUIRED) - set(payload)
    if unknown or missing:
        raise SourceError(f"declaration: unknown {sorted(unknown)}, missing {sorted(missing)}")
    for key, value in DECLARATION_VERSIONS.items():
        if payload[key] != value:
            raise SourceError(f"{key} {payload[key]!r} != {value}")
    texts = [k for k in DECLARATION_REQUIRED if k not in ("split_order", "split_roles", "provenance")]
    if any(not isinstance(payload[k], str) or not payload[k] for k in texts):
        raise SourceError("declaration text fields must be non-empty strings")
    if not isinstance(payload["provenance"], dict):
        raise SourceError("provenance must be a JSON object")
    order = payload["split_order"]
    if not isinstance(order, list) or not order or len(set(order)) != len(order):
        raise SourceError("split_order must list distinct split ids")
    payload["split_roles"] = split_roles(order, payload["split_roles"])
    return payload


def interactions_to_json(df: DataFrame) -> DataFrame:
    """One compact JSON object per row; null split and timestamp are kept."""
    return df.select("seq", F.to_json(F.struct(*CANONICAL_FIELDS), {"ignoreNullFields": "false"}).alias("value"))


def interactions_from_json(df: DataFrame) -> DataFrame:
    return canonical_from_lines(df.select(F.col("seq").alias("line"), "value"))


def toy_interactions(spark: SparkSession) -> DataFrame:
    """Small fixture: three learners, six bundles, rows with no, one or several KCs."""
    spec = [
        ("ann", 0, "fractions-1", 0, [3], 50.0, "a", "train"), ("ann", 1, "fractions-2", 1, [3, 8], 50.0, "a", "train"),
        ("ann", 2, "angles-1", 1, [], 90.5, "b", "train"), ("ann", 3, "angles-2", 0, [11, 3, 8], 120.0, "c", "valid"),
        ("bob", 0, "fractions-1", 1, [3], 7.0, "a", "train"), ("bob", 1, "roots-1", 0, [21], 9.25, "b", "train"),
        ("eve", 0, "roots-1", 1, [], 400.0, "a", "train"),
    ]
    rows = [(i, f"{u}-{o}", u, q, y, k, o, ts, f"{u}-{b}", s, True) for i, (u, o, q, y, k, ts, b, s) in enumerate(spec)]
    return spark.createDataFrame(rows, canonical_schema())
