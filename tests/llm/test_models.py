"""Language ID and toxicity: held-out accuracy on the given tables, and defined results for odd rows."""

import numpy as np
import pytest

from placeproof.llm import langid, toxicity
from placeproof.llm.common import table
from placeproof.llm.subwords import Scorer, Shape, train, window_sums

DATA = "/root/testdata/sf0.1"
ODD = [(1, None, "x"), (2, "", "x"), (3, "123 !!! 456", "x"), (4, "Один русский текст " * 20, "x"), (None, "the and of", None), (5, "the " * 50000, "x"), (5, "the", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


def test_language_of_held_out_texts(spark, docs):
    got = langid.identify(docs, langid.fit(docs, sample=800), carry=["lang"]).select("row.lang", "found.*").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert np.mean([r.rejected for r in got]) < 0.01


def test_language_of_odd_rows(spark, docs):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    got = {(r.doc_id, r.row.text): r for r in langid.identify(odd, langid.fit(docs, sample=400), carry=["doc_id", "text", "score"]).select("row", "found", "found.*").collect()}
    assert len(got) == len(ODD)
    for key in ((1, None), (2, ""), (3, "123 !!! 456")):
        assert (got[key].lang_pred, got[key].score, got[key].rejected) == ("und", 0.0, True)
    assert got[(4, ODD[3][1])].rejected and not got[(5, ODD[5][1])].rejected
    assert got[(None, "the and of")].held_out is False


def test_a_rare_language_is_a_class(spark, docs):
    """Four texts of a language among ten thousand are enough to be told from the others."""
    rare = spark.createDataFrame([(4 * i + 10**7 + (2 if i > 3 else 0), "один русский текст про дом и сад " * (i + 1), "ru") for i in range(8)], "doc_id long, text string, lang string")
    every = docs.select("doc_id", "text", "lang").unionByName(rare)
    known = langid.fit(every, sample=400)
    assert known.model.labels == ["de", "en", "es", "fr", "ru"]
    assert {r.lang_pred for r in langid.identify(rare, known).collect()} == {"ru"}


def test_language_without_teachers(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(rows, langid.fit(rows)).collect()] == [("und", 0.0)] * 2
    assert langid.identify(rows.limit(0), None).collect() == []


def test_toxicity_of_held_out_texts(spark, docs):
    labels = table(spark, DATA, "labels")
    model = toxicity.fit(docs, labels, sample=1500)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("score", "predicted", "toxic").collect()
    score, truth = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    order = np.argsort(np.argsort(score)) + 1
    n = truth.sum()
    assert (order[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n)) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    odd = toxicity.score(spark.createDataFrame(ODD, "doc_id long, text string, held_out string"), model).collect()
    assert len(odd) == len(ODD) and len({r.score for r in odd if r.doc_id in (1, 2)}) == 1
    misspelt = toxicity.score(spark.createDataFrame([(1, "the of and that worthles was the"), (2, "the of and that theron was the")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.score for r in misspelt}[1] > {r.doc_id: r.score for r in misspelt}[2]


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs.limit(5), toxicity.fit(docs, none)).collect()} == {0.5}


def test_scorer_is_the_model():
    """The amounts kept by word give the logits of the plain mean over all n-grams of all words."""
    shape = Shape(2, 4, 512, 8)
    texts = ["alpha beta beta", "gamma", "", "été x " * 30]
    model = train(texts, np.array([0, 1, 0, 1]), [0, 1], shape, 3, 0.3, 1)
    got = Scorer(shape, model.gram_scores(), model.bias).logits(texts)
    for text, row in zip(texts, got):
        parts = []
        for word in text.lower().split():
            ids = shape.grams([word])[0]
            parts.append((model.vectors[ids[ids >= 0]] @ model.weights).mean(axis=0))
        assert np.allclose(row, model.bias + (np.mean(parts, axis=0) if parts else 0), atol=1e-5)
    assert window_sums(np.ones((5, 1)), 3).tolist() == [[3], [3], [3]] and window_sums(np.ones((2, 1)), 3).tolist() == [[2]]
