"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseq.llm import language_id as _language_id
from lumenseq.llm import mixing as _mixing
from lumenseq.llm import near_copies as _near_copies
from lumenseq.llm import packing as _packing
from lumenseq.llm import quality as _quality
from lumenseq.llm.common import id_remainder, table
from lumenseq.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough confidence."""
    model = _language_id.fit(docs, id_remainder(F.col("doc_id"), 4) != 2)
    return _language_id.recognised(docs, model)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their bad lines."""
    return _quality.kept_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles of similarity 0.8 or more: the smallest id, or text hash without one.

    Fingerprints within two bits, then shared MinHash keys find the candidates; the shingle sets decide.
    """
    return _near_copies.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its weight in the mixture asks, dealt over all partitions."""
    return _mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return _packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language identification, fingerprints and tokens are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written once to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
