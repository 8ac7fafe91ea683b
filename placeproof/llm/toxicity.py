"""Toxicity by subword-bag embeddings averaged into a linear softmax, so unseen misspellings share n-gram vectors with known words.

The embeddings are averaged over windows of words, and a text counts as its most toxic window, whole texts being read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.llm.common import as_bytes
from placeproof.llm.subwords import Model, Scorer, Shape, batches_of, softmax, train

SHAPE = Shape(shortest=2, longest=6, buckets=1 << 17, dim=16)
SAMPLE, EPOCHS, RATE, SEED, SHARE, WINDOW = 3000, 8, 0.3, 7, 0.4, 12
FOLDS, HELD_OUT = 5, 0


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("long").cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most `sample` labelled texts that aren't held out, `SHARE` of them toxic if there are so many.

    The sample is picked by a hash of the id, at a rate taken from counts over all labels. Null ids and labels teach
    nothing; of several labels for an id the largest holds. Without any label the model says 0.5 to everything.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where(
        F.col("_toxic").isin(0, 1) & (fold("_id") != HELD_OUT)).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    counts = dict(known.groupBy("_toxic").count().collect())
    bad = min(counts.get(1, 0), int(sample * SHARE))
    wanted = {1: bad, 0: min(counts.get(0, 0), sample - bad)}
    rate = {k: min(1.0, 1.3 * n / max(1, counts.get(k, 0))) for k, n in wanted.items()}
    ticket = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 20)) / (1 << 20)
    few = known.where(ticket < F.when(F.col("_toxic") == 1, rate[1]).otherwise(rate[0])).orderBy("_toxic", F.xxhash64("_id", F.lit(SEED)), "_id").limit(2 * sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(few), "_id").orderBy(F.xxhash64("_id", F.lit(SEED)), "_id", "_text").limit(2 * sample).select("_text", "_toxic").toLocalIterator()
    got: dict[int, list[str]] = {0: [], 1: []}
    for text, toxic in rows:
        if len(got[toxic]) < wanted[toxic]:
            got[toxic].append(text)
    targets = np.array([0] * len(got[0]) + [1] * len(got[1]), dtype=np.int64)
    return train(got[0] + got[1], targets, [0, 1], SHAPE, EPOCHS, RATE, SEED, WINDOW)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, over its whole text; null and empty texts get the model's bias."""
    shared = docs.sparkSession.sparkContext.broadcast((model.shape, model.gram_scores(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            texts = as_bytes(batch.column(2))
            found = [softmax(scorer.logits([t.decode(errors="replace") for t in part], WINDOW))[:, 1] for part in batches_of(texts)]
            value = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
