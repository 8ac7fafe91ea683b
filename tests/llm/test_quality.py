"""Quality: held-out accuracy on the given tables, the corpus sums against plain loops, and defined results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeproof.llm import quality
from placeproof.llm.common import table

DATA = "/root/testdata/sf0.1"
ODD = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (None, "the and of", None), (5, "the " * 400000, "x"), (5, "the", "x"), (6, "|", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def model(spark, docs):
    return quality.fit(docs, table(spark, DATA, "labels"))


def test_quality_of_held_out_texts(spark, docs, model):
    got = quality.score(docs, model).join(table(spark, DATA, "labels"), "doc_id").where("held_out AND quality IS NOT NULL").select("score", "predicted", "quality").collect()
    score, truth = np.array([r.score for r in got]), np.array([r.quality for r in got])
    order = np.argsort(np.argsort(score)) + 1
    n = truth.sum()
    assert (order[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n)) > 0.99
    assert abs(score.mean() - truth.mean()) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_odd_rows(spark, model):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, held_out string").withColumns({"score": F.lit("s"), "features": F.lit(1)})
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score(odd.limit(0), model).collect() == []
    assert [r.held_out for r in got if r.doc_id is None] == [False]


@pytest.mark.parametrize("labels,want", [([], 0.5), ([(None, 1), (3, None)], 0.5), ([(i, 1) for i in range(20)], 0.999), ([(i, 0) for i in range(20)], 0.001)])
def test_labels_of_one_kind_or_none(spark, docs, labels, want):
    few = docs.where("doc_id < 20")
    got = quality.score(few, quality.fit(few, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
    assert got and all(abs(r.score - want) < 1e-6 for r in got)


def test_no_documents(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.score(none, quality.fit(none, labels)).collect() == []


def test_word_vectors_are_the_sums_over_all_texts(spark):
    texts = ["a b a, c!", "", None, "b b b", "c", "Ü ü 12 a | b"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got, index = quality.word_vectors(df), quality.index_vectors().astype(np.float64)
    sums, counts, words = np.zeros((quality.BUCKETS, quality.DIM)), np.zeros(quality.BUCKETS), quality.Words()
    for t in texts:
        ids = words.of((t or "").encode())
        for i, w in enumerate(ids):
            counts[w] += 1
            for j in range(max(0, i - quality.NEAR), min(len(ids), i + quality.NEAR + 1)):
                if j != i:
                    sums[w] += index[ids[j]]
    met = counts > 0
    want = sums[met] / counts[met, None] - sums.sum(axis=0) / counts.sum()
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got[met], want, atol=1e-5) and not got[~met].any()


def test_slices_of_a_long_text(monkeypatch):
    text = b"one two two three | 4 one " * 50
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    whole = quality.pooled([text, b""], vectors, quality.Words())
    monkeypatch.setattr(quality, "SLICE", 7)
    assert np.allclose(whole, quality.pooled([text, b""], vectors, quality.Words())) and not whole[1].any()
    v = vectors[quality.Words().of(text)]
    assert np.allclose(whole[0, -2:], [(v[1:] * v[:-1]).sum() / (len(v) - 1), (v[2:] * v[:-2]).sum() / (len(v) - 2)], rtol=1e-4)
