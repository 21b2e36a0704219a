"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseq.llm import backoff_lm, byte_cnn, language_id, licenses, mixing, multi_index, packing, phrases, quality, simhash, token_counts, vector_codes, warc
from lumenseq.llm.common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_license_scan", licenses.oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op3_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, 1 + 10 * CAST(j // 8 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (j % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to FROM h""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_backoff_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.lm_scores(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) == 2)


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op6_multi_index")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_source_mixing", """
WITH n AS (SELECT source, count(*) AS n, CAST(round(pow(count(*)::DOUBLE, 0.5) * 1e6) AS BIGINT) AS w FROM documents GROUP BY source),
rate AS (SELECT source, (SELECT sum(n) FROM n)::DOUBLE * w / (SELECT sum(w) FROM n)::DOUBLE / n AS rate FROM n),
cdf AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
        FROM (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rate)),
k AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS name FROM documents),
d AS (SELECT *, CAST('0x' || substr(md5('17:' || name), 1, 13) AS BIGINT) / pow(16, 13) AS u FROM k),
steps AS (SELECT source, list(p ORDER BY k) AS ps FROM cdf GROUP BY source),
t AS (SELECT d.*, len(list_filter(ps, lambda p: p <= u)) AS times FROM d JOIN steps ON steps.source IS NOT DISTINCT FROM d.source),
c AS (SELECT doc_id, text, lang, source, n_chars, name, unnest(range(1, times + 1)) AS copy FROM t)
SELECT doc_id, text, lang, source, n_chars, copy,
       CAST('0x' || substr(md5('18:' || name || ':' || copy), 1, 13) AS BIGINT) / pow(16, 13) AS mix_key FROM c""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_line_quality", quality.oracle())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_quality(table(spark, sf_dir, "documents")).drop("share_kept", "clean_text")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs.select("doc_id", "text"), model=model).select("doc_id", held_out.alias("held_out"), "_language.lang_pred", "_language.score", "_language.rejected")


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op11_byte_cnn")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    net = byte_cnn.fit(docs, labels, ~held_out)
    return byte_cnn.classify(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op12_vector_codes", vector_codes.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


@query("op13_phrases", phrases.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
