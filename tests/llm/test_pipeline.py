"""The pipeline's stages: what they keep, on whole tables and on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from placeproof.llm import packing, simhash
from placeproof.llm.common import stored, table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def passed(spark):
    rows, out = table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, rows, rows := stored(stage(spark, rows, DATA), name)))
    return out


def test_stages_keep_the_columns_and_only_lose_rows(passed):
    assert [name for name, _, _ in passed] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "mixing", "best_fit_packing"]
    for _, before, after in passed[:-1]:
        assert after.dtypes == before.dtypes
        assert after.join(before, "doc_id", "left_anti").count() == 0


def test_clean_documents_pass_language_id(passed):
    _, before, after = passed[0]
    assert after.count() >= 0.99 * before.count() and after.exceptAll(before).count() == 0


def shingles(text):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i:i + 5]) for i in range(len(parts) - 4)} or ({b" ".join(parts)} if parts else set())


def like(a, b):
    return a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def test_one_document_of_each_group_stays(passed):
    """Every document that went is like one of a smaller id, over links; of the pairs that are like, nine in ten lost one."""
    _, before, after = passed[1]
    texts = {r.doc_id: shingles(r.text) for r in before.collect()}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    ids = sorted(texts)
    near = {i: [j for j in ids if j != i and like(texts[i], texts[j])] for i in ids}
    assert all(near[i] for i in ids if i not in kept)
    left = [(i, j) for i in kept for j in near[i] if i < j and j in kept]
    pairs = sum(len(v) for v in near.values()) // 2
    assert pairs > 20 and len(left) <= 0.1 * pairs


@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.95])
def test_planted_copies_are_caught(spark, similarity):
    rng, rows, wanted = random.Random(int(100 * similarity)), [], 0
    for i in range(120):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        copy, own = list(words), shingles(" ".join(words))
        while True:
            trial = list(copy)
            trial[rng.randrange(len(trial))] = f"x{rng.randrange(10**6)}"
            if len(own & shingles(" ".join(trial))) < similarity * len(own | shingles(" ".join(trial))):
                break
            copy = trial
        rows += [(2 * i, " ".join(words), "n"), (2 * i + 1, " ".join(copy), "n")]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()}
    assert all(2 * i in kept for i in range(120))
    assert sum(2 * i + 1 not in kept for i in range(120)) >= 108


def test_a_crowd_of_copies_and_a_common_passage(spark):
    """Hundreds of near copies of one text leave one; texts that only share a passage all stay; ids may be null or repeat."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    crowd = [" ".join(base[:k] + [f"z{k}"] + base[k + 1:]) for k in range(5, 115)] * 3
    passage = " ".join(f"p{i}" for i in range(60))
    alone = [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(crowd)] + [(1000 + i, t) for i, t in enumerate(alone)] + [(None, crowd[0]), (None, "only this"), (None, "only this"), (7, "one text"), (7, "another text")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(0, crowd[0]), *((1000 + i, t) for i, t in enumerate(alone)), (None, "only this"), (7, "one text"), (7, "another text")], key=str)


def test_repeats_are_gone(passed):
    texts = sorted((r.doc_id, r.text.encode()) for r in passed[2][2].collect())
    seen, repeated = set(), 0
    for _, text in texts:
        own = {text[i:i + 100] for i in range(len(text) - 99)}
        repeated += len(own & seen)
        seen |= own
    assert repeated < 0.001 * len(seen)
    assert all(r.n_chars == len(r.text) for r in passed[2][2].collect())


def test_packing_covers_what_was_drawn(passed):
    _, before, after = passed[4]
    want = {r.doc_id: r.n for r in before.select("doc_id", packing.words(F.col("text")).alias("n")).collect()}
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == want


def test_run_equals_its_stages(spark, passed):
    assert corpus_pipeline.run(spark, DATA).exceptAll(passed[4][2]).count() == 0


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "the and of that", "en", "s", 15), (3, "the and of that", "en", "s", 15), (None, "the and of it", "en", "s", 13), (4, "the thing and " * 9000, "en", "s", 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_head": F.lit(1), "n_bytes": F.lit("x"), "found": F.lit(2), "_rejected": F.lit(True)})
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, DATA), name)
            if name != "best_fit_packing":
                assert out.columns == odd.columns
            out.count()


def test_sizes_and_bitmaps_exclude_no_similar_text(spark):
    rng, rows, sets = np.random.default_rng(11), [], {}  # texts of one base, more and more changed
    for i in range(60):
        base = [f"w{n}" for n in rng.integers(0, 500, int(rng.choice([6, 20, 90, 2000])))]
        for j in range(8):
            words = base[: max(1, len(base) - int(rng.integers(0, 1 + len(base) // 4)))]
            changed = [f"x{n}" if rng.random() < 0.01 * j else w for n, w in enumerate(words)]
            rows.append((f"{i:02}-{j}", " ".join(changed)))
            sets[rows[-1][0]] = {tuple(changed[k:k + 5]) for k in range(max(1, len(changed) - 4))}
    marks = simhash._shingle_sets(spark.createDataFrame(rows, "node string, text string"), 5).drop("hashes")
    leads = marks.select(F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("bits").alias("lead_bits"))
    pairs = marks.join(leads, F.left("node", F.lit(2)) == F.left("lead", F.lit(2)))
    found = pairs.select("node", "lead", simhash._may_be_alike(0.8).alias("may")).collect()
    alike = {(r.node, r.lead): len(sets[r.node] & sets[r.lead]) >= 0.8 * len(sets[r.node] | sets[r.lead]) for r in found}
    assert 300 < sum(alike.values()) < len(found) and all(r.may for r in found if alike[r.node, r.lead])
    assert not all(r.may for r in found)
