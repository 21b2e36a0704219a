"""Role datasets with a sealed identity: a document and hash leaves beside the rows, held against them on every read.

The sealed document names the hash and row count of every split, the vocabularies, the logical hash and the contract hash.
The lowest level of each split's hash tree is stored as a table, so one role is proved without opening another, and a
difference is traced to the leaf that holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseq.operators import identity as I
from lumenseq.session import cut_lineage
from lumenseq.sources import files, sinks
from lumenseq.sources.files import SourceError

DOCUMENT = "sealed.json"


def ordered_ids_hash(ids: DataFrame) -> str | None:
    """Tree hash of ``(idx, id)`` in file order; None for an empty file."""
    found = I.tree_hash(ids.select(F.lit(0).alias("g"), F.col("idx").alias("seq"), "id"), F.col("id").cast("string"), "g").first()
    return found["tree_hash"] if found else None


def identity_document(declared: dict, splits: list[dict], vocabularies: dict[str, str | None]) -> dict:
    """Splits, vocabulary hashes, the logical hash that binds them and the contract hash over the declared semantics."""
    _, logical = I.dataset_identity(
        declared["dataset_id"], declared["protocol_id"], declared["preprocessing_version"], vocabularies.get("learners"),
        [(s["split"], s["tree_hash"], s["row_count"]) for s in splits], vocabularies.get("items"), vocabularies.get("kcs"))
    _, contract = I.contract_identity(
        logical, declared["canonical_schema_version"], declared["bundle_semantics_id"], declared["oov_representation_semantics_id"],
        declared["metric_mask_semantics"], declared["split_roles"])
    return {"splits": splits, "vocabularies": vocabularies, "logical_hash": logical, "contract_hash": contract}


def directory_identity(data: files.CanonicalDirectory) -> dict:
    """Identity document of a canonical directory, its id files in their own order."""
    splits = [r.asDict() for r in I.tree_hash(data.rows, I.row_json(data.rows), "split").orderBy("split").collect()]
    ids = {"learners": data.learners, "items": data.items, "kcs": data.kcs}
    return identity_document(data.declared, splits, {name: ordered_ids_hash(table) for name, table in ids.items()})


def write_sealed(rows: DataFrame, path: str, declared: dict, fanout: int = I.TREE_FANOUT, **vocabularies: DataFrame) -> dict:
    """Role files, leaves and the sealed document; ``vocabularies`` are ``learners``, ``items`` and ``kcs`` as ``(idx, id)``."""
    spark = rows.sparkSession
    sinks.write_roles(rows, f"{path}/rows", declared["split_roles"])
    leaves = I.tree_leaves(rows, I.row_json(rows), "split", fanout=fanout)
    leaves.write.parquet(f"{path}/leaves")
    stored = spark.read.parquet(f"{path}/leaves")
    splits = [r.asDict() for r in I.tree_roots(stored, "split").orderBy("split").collect()]
    document = identity_document(declared, splits, {name: ordered_ids_hash(table) for name, table in vocabularies.items()})
    sinks.write_json(spark, f"{path}/{DOCUMENT}", document | {"declaration": declared, "fanout": fanout})
    return document


@dataclass
class Sealed:
    """A sealed role dataset whose document agrees with itself."""

    spark: SparkSession
    path: str
    document: dict

    @property
    def split_of(self) -> dict[str, str]:
        return {role: split for split, role in self.document["declaration"]["split_roles"]}

    @property
    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/leaves")


def open_sealed(spark: SparkSession, path: str) -> Sealed:
    """Read the document and hold its two hashes and the stored leaves' roots against it; no row is read."""
    document = sinks.read_json(spark, f"{path}/{DOCUMENT}")
    again = identity_document(document["declaration"], document["splits"], document["vocabularies"])
    for name in ("logical_hash", "contract_hash"):
        if again[name] != document.get(name):
            raise SourceError(f"{path}: sealed {name} does not match its document")
    sealed = Sealed(spark, path, document)
    roots = {r["split"]: (r["tree_hash"], r["row_count"]) for r in I.tree_roots(sealed.leaves, "split").collect()}
    if roots != {s["split"]: (s["tree_hash"], s["row_count"]) for s in document["splits"]}:
        raise SourceError(f"{path}: stored leaves do not match the sealed splits")
    return sealed


def damage(sealed: Sealed, rows: DataFrame, split: str) -> DataFrame:
    """Leaves of ``split`` in which ``rows`` differ from what was sealed."""
    stored = sealed.leaves.where(F.col("split") == split)
    return I.damaged_leaves(stored, I.tree_leaves(rows, I.row_json(rows), "split", fanout=sealed.document["fanout"]), "split")


def read_sealed_role(sealed: Sealed, role: str) -> DataFrame:
    """Rows of one role, proved against their leaves; a row of another split or any difference fails. Other roles stay closed."""
    if role not in sealed.split_of:
        raise SourceError(f"role {role!r} is not declared")
    split = sealed.split_of[role]
    rows = cut_lineage(files.read_role(sealed.spark, f"{sealed.path}/rows", role))
    foreign = rows.where(~F.col("split").eqNullSafe(F.lit(split))).limit(3).collect()
    if foreign:
        raise SourceError(f"{role} files hold another split: {[r['interaction_id'] for r in foreign]}")
    bad = damage(sealed, rows, split).orderBy("leaf").limit(3).collect()
    if bad:
        raise SourceError(f"{role} rows differ from the sealed split {split!r} in " + ", ".join(f"leaf {r['leaf']} (seq {r['first_seq']} to {r['last_seq']})" for r in bad))
    return rows
