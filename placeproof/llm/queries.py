"""Registered queries: every operator over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.llm import hilbert, langid, mixing, nndescent, packing, quality, repair, simhash, simplex, suffix_dedup, toxicity, wand, warc
from placeproof.llm.common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


MIX_SHARE = 0.6


@query("op1_mixing", mixing.oracle(
    "documents", {"source": "source", "lang": "lang", "topic": mixing.TOPIC_SQL}, mixing.TARGETS, "CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')), 0) AS BIGINT)", MIX_SHARE))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.expr(mixing.TOPIC_SQL)}
    return mixing.mix(table(spark, sf_dir, "documents"), dimensions, mixing.TARGETS, packing.words(F.col("text")), MIX_SHARE)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.words(F.col("text")))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op5_hilbert_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"), hilbert.text_dimensions(F.col("text")))


@query("op10_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY body) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY body) THEN NULL ELSE max(page_id) OVER (PARTITION BY body) END AS refers_to,
  true AS verified, sha256(body) AS payload_address
FROM p""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query("op6_nn_descent")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_exact_top_k")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.top_k(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


@query("op11_simplex_clustering", simplex.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_structure_repair", repair.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(table(spark, sf_dir, "conversations"))


@query("op13_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
