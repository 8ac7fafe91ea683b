"""From raw documents to packed training sequences: language ID, near-dedup, repeated passages, mixing and packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
documents. Between stages the rows are written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.llm import langid, mixing, packing, simhash, suffix_dedup
from placeproof.llm.common import stored, table

MIX_SHARE = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject; `lang` stays as the source says it."""
    found = langid.identify(docs, langid.fit(docs), carry=docs.columns)
    return found.where("NOT found.rejected").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share 0.8 or more of their five-word shingles: the one with the smallest id."""
    return simhash.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur earlier; a document that was repeated as a whole goes, an empty one stays."""
    cut = suffix_dedup.remove_repeats(docs, carry=docs.columns, with_text=True)
    changed = F.col("found.n_removed") > 0
    values = {"text": F.when(changed, F.col("found.kept_text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("found.kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.where("found.n_bytes = 0 OR found.n_removed < found.n_bytes").select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that bring tokens nearest to the target shares."""
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.expr(mixing.TOPIC_SQL)}
    drawn = mixing.mix(docs, dimensions, mixing.TARGETS, packing.words(F.col("text")), MIX_SHARE).where("kept").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_drawn"]), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: where every piece of every document lies."""
    return packing.pack(docs, packing.words(F.col("text")))


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", passages), ("mixing", mixture), ("best_fit_packing", packed)]

# Learned language ID, components over fingerprints and greedy packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
