"""Centroid clustering against plain integers: ties, repeats, components of any size, odd rows."""

import hashlib

import numpy as np
import pytest

from placeproof.llm import simplex
from placeproof.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def brute(rows, k=16, rounds=3):
    """The contract with Python integers: every vector against every centroid."""
    kept = [(i, [int(np.floor(64 * x)) if abs(x) < 1e12 else 64 * int(x) for x in e], e) for i, e in rows
            if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    def start(row):
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[2])
    centers = [v for _, v, _ in sorted(kept, key=start)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    found = [(i, *nearest(v)) for i, v, _ in kept]
    by = {}
    for _, d, j in found:
        by[j] = by.get(j, 0) + d

    def fits(x):
        return x if x < 2**63 else None
    return sorted(((i, j, fits(d), fits(by[j]) if all(fits(f[1]) is not None for f in found if f[2] == j) else None,
                    fits(sum(by.values())) if all(fits(f[1]) is not None for f in found) else None,
                    hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_given_vectors(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert result(simplex.cluster(rows)) == brute([(r.vec_id, r.embedding) for r in rows.collect()])


@pytest.mark.parametrize("wide", [False, True])
def test_odd_vectors(spark, wide):
    rng = np.random.default_rng(3)
    points = rng.normal(0, 0.3, (40, 64))
    rows = [(i, [float(x) for x in points[i % 40]]) for i in range(120)] + [(None, [0.5] * 64), (7, [0.25] * 64), (7, [0.25] * 64)]
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [float("nan")] * 64), (505, [float("inf")] * 64)]
    if wide:
        rows += [(600 + i, [float(x) * 10.0 ** (3 * i) for x in points[i]]) for i in range(40)] + [(900, [-1.7e308] * 64), (901, [3e306] * 63 + [-1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert result(simplex.cluster(df)) == brute(rows)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert result(simplex.cluster(df)) == brute(rows)
    empty = simplex.cluster(df.limit(0))
    assert empty.collect() == [] and empty.dtypes == simplex.cluster(df).dtypes


def test_bounds_hold_and_filter(spark):
    rng = np.random.default_rng(5)
    centers = rng.integers(-30, 30, (16, 64))
    vectors = centers[rng.integers(0, 16, 2000)] + rng.integers(-6, 7, (2000, 64))
    moved = centers + rng.integers(-3, 4, (16, 64))
    base = simplex.Base.of(centers.tolist())
    open_ = simplex.possible(base.apexes(vectors), base.apexes(moved))
    real = ((vectors[:, None] - moved[None]) ** 2).sum(axis=2)
    assert open_[np.arange(2000), real.argmin(axis=1)].all() and open_.mean() < 0.2
