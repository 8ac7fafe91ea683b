"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated probabilities.

Random indexing: every word has a fixed sparse index vector of a few +1 and -1; a word's vector is the sum of the index vectors
of all words that stand near it anywhere in the corpus. The sums run over whole texts of all documents, as counts in the
tasks and one small row a bucket of words after them; no label takes part. A document is the mean and the spread of its words' vectors,
and how alike words next to each other and next but one are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.llm.common import as_bytes

BUCKETS, DIM, NONZERO, NEAR = 1 << 15, 32, 4, 2
SAMPLE, EPOCHS, BATCH, HIDDEN, RATE, DECAY, SEED = 6000, 60, 64, 32, 0.01, 1e-4, 11
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
FEATURES = 2 * DIM + 1 + NEAR
KEPT_WORDS, SLICE = 400_000, 1 << 18
WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
"""Words, numbers and runs of signs of UTF-8 bytes, capital letters kept: shouting is other words."""


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("long").cast("string")) % FOLDS


class Words(dict):
    """Bucket of every word met; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word) % BUCKETS
        return found

    def of(self, text: bytes) -> np.ndarray:
        words = WORD.findall(text)
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


def index_vectors(buckets: int = BUCKETS, dim: int = DIM, nonzero: int = NONZERO, seed: int = SEED) -> np.ndarray:
    """The sparse ternary vector of every bucket, the same in all tasks: half of its places are +1, half -1."""
    rng = np.random.default_rng(seed)
    places = rng.permuted(np.tile(np.arange(dim, dtype=np.int8), (buckets, 1)), axis=1)[:, :nonzero]
    out = np.zeros((buckets, dim), dtype=np.int8)
    for i in range(nonzero):
        out[np.arange(buckets), places[:, i]] = 1 - 2 * (i % 2)
    return out


def add_contexts(sums: np.ndarray, counts: np.ndarray, ids: np.ndarray, begins: np.ndarray, index: np.ndarray) -> None:
    """Add to every word's row the index vectors of the words up to NEAR places away in the same text."""
    n = len(ids)
    if not n:
        return
    text = np.zeros(n, dtype=np.int32)
    np.add.at(text, begins[begins < n], 1)
    text = np.cumsum(text)
    own, near = index[ids], np.zeros((n, index.shape[1]), dtype=np.int16)
    for step in range(1, NEAR + 1):
        same = (text[step:] == text[:-step])[:, None]
        near[step:] += own[:-step] * same
        near[:-step] += own[step:] * same
    order = np.argsort(ids, kind="stable")
    kinds, at, times = np.unique(ids[order], return_index=True, return_counts=True)
    sums[kinds] += np.add.reduceat(near[order], at, axis=0, dtype=np.int64)
    counts[kinds] += times


def slices(texts: list[bytes], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words of several texts in a row, and where each text begins."""
    parts, held = [], 0
    for text in texts:
        parts.append(words.of(text))
        held += len(parts[-1])
        if held >= SLICE:
            yield np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
            parts, held = [], 0
    if parts:
        yield np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """One row a bucket: the mean context over the whole corpus, less the mean of all words, at length one; zeros where no word is.

    What comes to the driver is BUCKETS x DIM sums at most, whatever the corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words = index_vectors(), Words()
        sums, counts = np.zeros((BUCKETS, DIM), dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for ids, begins in slices(as_bytes(batch.column(0)), words):
                add_contexts(sums, counts, ids, begins, index)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int64()), pa.array(counts[met]), *[pa.array(sums[met, i]) for i in range(DIM)]], ["bucket", "n", *[f"s{i}" for i in range(DIM)]])
    names = ["n", *[f"s{i}" for i in range(DIM)]]
    partial = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in names))
    got = partial.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out, bucket, n = np.zeros((BUCKETS, DIM), dtype=np.float64), got.column("bucket").to_numpy(), got.column("n").to_numpy().astype(np.float64)
    if len(bucket):
        context = np.column_stack([got.column(f"s{i}").to_numpy() for i in range(DIM)]).astype(np.float64)
        vectors = context / n[:, None] - context.sum(axis=0) / n.sum()
        out[bucket] = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, words: Words) -> np.ndarray:
    """Mean and spread of the word vectors of whole texts, whether there is a word, and the mean cosine of words one and two places
    apart. A long text is summed in slices."""
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        ids = words.of(text)
        if len(ids):
            total, square, alike = np.zeros(DIM), np.zeros(DIM), np.zeros(NEAR)
            for begin in range(0, len(ids), SLICE):
                part = vectors[ids[begin:begin + SLICE]]
                total += part.sum(axis=0, dtype=np.float64)
                square += np.einsum("ij,ij->j", part, part, dtype=np.float64)
                for step in range(1, NEAR + 1):
                    before = vectors[ids[max(0, begin - step):begin + len(part) - step]]
                    alike[step - 1] += np.einsum("ij,ij->", part[len(part) - len(before):], before, dtype=np.float64)
            mean = total / len(ids)
            out[i] = np.r_[mean, np.sqrt(np.maximum(0, square / len(ids) - mean**2)), 1, alike / np.maximum(1, len(ids) - np.arange(1, NEAR + 1))]
    return out


@dataclass(frozen=True)
class Model:
    """Word vectors and a network: scaled inputs, one layer of tanh units, one logit, and the temperature it is divided by."""

    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.center) / self.scale @ self.first + self.first_bias)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.second + self.second_bias) / self.temperature, -50, 50)))


def _network(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Two layers fitted by Adam on the weighted log loss."""
    rng = np.random.default_rng(SEED)
    parts = [rng.normal(0, x.shape[1]**-0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    drift, power, turn = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for begin in range(0, len(x), BATCH):
            rows = order[begin:begin + BATCH]
            hidden = np.tanh(x[rows] @ parts[0] + parts[1])
            slope = weight[rows] * (1 / (1 + np.exp(-np.clip(hidden @ parts[2] + parts[3][0], -50, 50))) - y[rows]) / len(rows)
            back = np.outer(slope, parts[2]) * (1 - hidden**2)
            steps = [x[rows].T @ back + DECAY * parts[0], back.sum(axis=0), hidden.T @ slope + DECAY * parts[2], np.array([slope.sum()])]
            turn += 1
            for i, step in enumerate(steps):
                drift[i] = 0.9 * drift[i] + 0.1 * step
                power[i] = 0.999 * power[i] + 0.001 * step**2
                parts[i] = parts[i] - RATE * (drift[i] / (1 - 0.9**turn)) / (np.sqrt(power[i] / (1 - 0.999**turn)) + 1e-8)
    return parts[0], parts[1], parts[2], float(parts[3][0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Word vectors from all texts, and a network from at most `sample` labelled rows that aren't held out.

    Half of the sample is of the rarer label if there are so many; rows are weighted back to the labels' shares among all labels, so
    scores are probabilities of the corpus. A fifth of the sample only sets the temperature. Rows are picked by a hash, and their
    texts are pooled in the tasks: the driver gets vectors. Null ids and labels teach nothing; of several labels for an id the largest
    holds; of equal ids any text may be drawn. With labels of one kind, or none, every score is that kind's share, or 0.5.
    """
    vectors = word_vectors(docs, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1) & (fold("_id") != HELD_OUT)).groupBy("_id").agg(F.max("_label").alias("_label"))
    counts = {0: 0, 1: 0} | dict(known.groupBy("_label").count().collect())
    rare = min(counts, key=counts.get)
    wanted = {rare: min(counts[rare], sample // 2)}
    wanted[1 - rare] = min(counts[1 - rare], sample - wanted[rare])
    rates = {k: min(1.0, 1.2 * wanted[k] / max(1, counts[k])) for k in wanted}
    ticket = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 20)) / (1 << 20)
    few = known.where(ticket < F.when(F.col("_label") == 1, rates[1]).otherwise(rates[0])).orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(2 * sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = pooled(as_bytes(batch.column(2)), shared.value, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], ["id", "label", "features"])
    taught = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(few), "_id").select(
        "_id", "_label", "_text").mapInArrow(run, "id long, label int, features array<double>")
    got = [r for label in (0, 1) for r in taught.where(F.col("label") == label).orderBy(F.xxhash64("id", F.lit(SEED)), "id", "features").limit(wanted[label]).collect()] if sum(wanted.values()) else []
    x, y = np.array([r["features"] for r in got]).reshape(len(got), FEATURES), np.array([r["label"] for r in got], dtype=np.float64)
    center, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) if len(got) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(got) else 0.5
        return Model(vectors, center, scale, np.zeros((len(center), 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()) * len(y) / sum(counts.values())
    checked = np.arange(len(y)) % 5 == 0 if len(y) >= 100 else np.ones(len(y), dtype=bool)
    teach = ~checked if len(y) >= 100 else checked
    scaled = (x - center) / scale
    parts = _network(scaled[teach], y[teach], weight[teach])
    logits = np.tanh(scaled[checked] @ parts[0] + parts[1]) @ parts[2] + parts[3]
    heats = np.geomspace(0.25, 16, 49)
    loss = [(weight[checked] * np.logaddexp(0, np.where(y[checked] == 1, -1, 1) * logits / h)).sum() for h in heats]
    return Model(vectors, center, scale, *parts, float(heats[int(np.argmin(loss))]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, over its whole text; all texts without a word get the same score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            value = shared.value.scores(pooled(as_bytes(batch.column(2)), shared.value.vectors, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value), pa.array((value >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
