"""NN-descent and BM25 search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeproof.llm import nndescent, wand


def test_links_of_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    noisy = lambda c, s: (c + rng.normal(0, s, 16)).tolist()
    centres = rng.normal(0, 1, (12, 16))
    vectors = [(noisy(c, 0.02 + 0.02 * (i % 4)), i % 2) for i, c in enumerate(centres) for _ in range(3 + 5 * i)]
    vectors += [(noisy(centres[0], 0.16), 0) for _ in range(90)] + [(rng.normal(0, 1, 16).tolist(), 0) for _ in range(300)]
    vectors += [(vectors[0][0], 0), (vectors[0][0], 0), (vectors[0][0], 1), ([2 * x for x in vectors[0][0]], 0)]
    rows = [(i, v, k, "c") for i, (v, k) in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 0, ""), (n + 1, [0.0] * 16, 0, ""), (n + 2, [float("nan")] * 16, 0, ""), (n + 3, [None] * 16, 0, ""), (n + 4, vectors[0][0], None, ""), (n + 5, [float("inf")] + [0.0] * 15, 1, "")]
    got = {r.vec_id: r for r in nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, sim string")).collect()}
    unit = np.array([v for v, _ in vectors])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([k for _, k in vectors])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(n, dtype=bool)
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.9 * linked.sum()
    component = np.arange(n)
    for _ in range(n):
        least = np.minimum(component, np.where(linked, component, n).min(axis=1))
        if (least == component).all():
            break
        component = least
    assert np.mean([got[i].component_id == component[i] for i in range(n)]) > 0.95
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + 6))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert nndescent.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_a_crowd_is_counted_exactly(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 1, 24)
    vectors = [(centre + rng.normal(0, s, 24)) for s in (0.05, 0.2) for _ in range(150)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    got = {r.vec_id: r.n_links for r in nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array(vectors)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= true).all() and found.sum() >= 0.98 * true.sum()


def test_crowds_that_touch_are_one_component(spark):
    rng = np.random.default_rng(5)
    a, b, c = np.linalg.qr(rng.normal(size=(24, 3)))[0].T
    turned = lambda angle: np.cos(angle) * a + np.sin(angle) * b
    vectors = [turned(t) + rng.normal(0, 0.015, 24) for t in (0, 0.29) for _ in range(40)]
    vectors += [turned(-0.32), turned(0.64), c] + [rng.normal(0, 1, 24) for _ in range(60)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(200, vectors[0].tolist(), 1), (201, vectors[80].tolist(), 1), (202, vectors[0].tolist(), 2)]
    got = {r.vec_id: r for r in nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([k for _, _, k in rows])
    true = ((unit @ unit.T >= 0.93) & (label[:, None] == label)).sum(axis=1) - 1
    assert [got[i].n_links for i, _, _ in rows] == true.tolist()
    assert true[:80].min() > 60 and {got[i].component_id for i in range(82)} == {0}


def lonely_pairs(n, pairs):
    """Vectors without neighbours but one each for the first `pairs`, at a cosine of 0.94."""
    rng = np.random.default_rng(11)
    unit = rng.normal(size=(n, 48))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, 48))
    side -= (side * unit[:pairs]).sum(axis=1, keepdims=True) * unit[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.vstack([unit, 0.94 * unit[:pairs] + np.sqrt(1 - 0.94**2) * side])


def test_trees_keep_the_recall_of_blocks_at_every_size():
    for bits in range(25):
        meet = (1 - math.acos(0.93) / math.pi) ** bits
        assert 1 - (1 - meet) ** nndescent.trees_for(bits, 0.93) >= 0.95


def test_pairs_without_other_neighbours_are_found(spark):
    vectors = lonely_pairs(9000, 300)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    assert nndescent.near_vectors(rows).where("n_links = 1").count() >= 0.95 * 600
    with pytest.raises(RuntimeError):
        nndescent.near_vectors(rows, trees=1, rounds=1, tries=1)


def brute(docs, query, k):
    bags = [(d, Counter(re.findall(r"\w+", (t or "").lower()))) for d, t in docs if d is not None]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    freq = Counter(w for _, b in bags for w in b)
    asked = {w for d, b in bags if d == query for w in b}
    scores = []
    for d, b in bags:
        s = sum(math.log(1 + (len(bags) - freq[w] + 0.5) / (freq[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in asked if w in b)
        if s > 0 and d != query:
            scores.append((-round(s, 9), d))
    return sorted(scores)[:k]


def test_search_finds_the_exact_best(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 50, 500])]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 20, 200]))) for i in range(600)] + [(700 + i, "same words here") for i in range(30)] + [(800, None), (900, ""), (None, "same words"), (1000, "Same WORDS, here!"), (1100, "x" * 70000)]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, score string")
    got = {}
    for r in wand.top_k(df, F.col("doc_id") % 100 == 0, k=7, shard_docs=150).collect():
        got.setdefault(r.query_id, []).append((r.rank, -round(r.score, 9), r.doc_id))
    for query in (d for d, _ in docs if d is not None and d % 100 == 0):
        assert [x[1:] for x in sorted(got.get(query, []))] == brute(docs, query, 7)
    assert 800 not in got and 900 not in got
    assert wand.top_k(df.limit(0), F.col("doc_id") % 100 == 0).collect() == []


def test_queries_are_copied_once_a_shard_and_shards_grow(spark, monkeypatch):
    """The work of copying queries doesn't grow with queries times rows; several groups of queries and tiles give the same hits."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words[:rng.choice([10, 300])], k=rng.choice([3, 30, 90])))) for i in range(800)]
    rows += [(i + 800, t) for i, t in rows[:100]] + [(3, "w1 w2 again"), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(wand, "SHARDS", 3)
    for name, value in (("ASKED_WORDS", 400), ("TILE", 100), ("TILE_WORDS", 2000), ("BLOCK", 64), ("BATCH", 4), ("PASS", 2)):
        monkeypatch.setattr(wand, name, value)
    found = wand.top_k(df, F.col("doc_id") % 50 == 3, k=6, shard_docs=10)
    shards = re.findall(r"sequence\(0, (\d+)", found._jdf.queryExecution().logical().toString())
    assert "2" in shards and "90" not in shards
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, -round(r.score, 9), r.doc_id))
    for query in {d for d, _ in rows if d % 50 == 3}:
        assert [x[1:] for x in sorted(got[query])] == brute(rows, query, 6)
