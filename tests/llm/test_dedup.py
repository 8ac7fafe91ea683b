"""SimHash and suffix-array dedup against brute force, on the odd rows that tables hold and on made-up crowds."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from placeproof.llm import simhash, suffix_dedup
from placeproof.llm.components import components

SCHEMA = "doc_id long, text string, lang string, fp string, b long, t string, component string"


def odd_rows():
    """Nulls, blanks, ties, repeats, one very long text, and columns named like the operators' own."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(120)]
    texts = [None, "", " \t\n", "one", "One", "two words", "a" * 450, "ab" * 200, " ".join(base), " ".join(base), " ".join(base[:60]), " ".join(base[20:]),
             "été " * 60, "x" + " ".join(base), " ".join(word() for _ in range(30000)), " ".join(base[:119] + ["other"])]
    rows = [(i, t, "en", "fp", 1, "t", "c") for i, t in enumerate(texts)]
    return [*rows, (8, " ".join(base), None, None, None, None, None), (3, "other text", "de", "", 2, "", ""), (None, " ".join(base[5:]), "en", "", 3, "", ""), (None, None, None, None, None, None, None)]


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (41, 0), (41, 0)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 5)], "a long, b long"), "a", "b").collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == groups([x for x in links if x[0] != x[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_simhash_on_odd_rows(spark):
    rows = odd_rows()
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    prints = {i: plain_fingerprint(r[1]) for i, r in enumerate(rows)}
    label = groups([(a, b) for a in prints for b in prints if bin(prints[a] ^ prints[b]).count("1") <= 2], prints)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[label[i]] = min(least.get(label[i], r[0]), r[0])
    want = [(r[0], f"{prints[i]:016x}", least.get(label[i])) for i, r in enumerate(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("crowded", [0, 3, 1024])
def test_grid_join_finds_every_link(crowded):
    rng = np.random.default_rng(crowded)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for c in centres for k in (1, 2, 2, 3, 4)]
    fps = np.unique(np.r_[centres, np.array(flips, dtype=np.uint64), np.array([0, 1, 3, 2**64 - 1], dtype=np.uint64)])
    a, b = simhash.links_in_cells(*simhash.spread_over_grid(fps, 8, 2), 2, crowded)
    assert (np.bitwise_count(fps[:, None] ^ fps) <= 2).sum() > len(fps)
    want = groups([(x, y) for x in fps.tolist() for y in fps.tolist() if bin(x ^ y).count("1") <= 2], fps.tolist())
    assert groups(zip(a.tolist(), b.tolist()), fps.tolist()) == want


def test_half_ball_has_one_of_each_pair():
    ball = {tuple(v) for v in simhash.half_ball(4, 2).tolist()}
    assert len(ball) == (2 * 4 + 2 * 4 * 4) // 2 and not any(tuple(-x for x in v) in ball for v in ball)


def plain_repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by a set of all strings, in the order the operator documents."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0], r[1])):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if text[i:i + length] in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(text[i:i + length])
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block_bytes, crowd", [(700, 1024), (1 << 20, 1024), (700, 1), (3000, 2)])
def test_suffix_dedup_on_odd_rows(spark, block_bytes, crowd):
    rows = [r for r in odd_rows() if r[0] is not None]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), block_bytes=block_bytes, crowd=crowd).collect()
    assert sorted(tuple(r[:5]) for r in got) == plain_repeats([(r[0], (r[1] or "").encode()) for r in rows])
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in got)


def test_suffix_dedup_keeps_columns_and_null_ids(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = suffix_dedup.remove_repeats(df, carry=df.columns, with_text=True).collect()
    assert sorted(str(tuple(r.row)) for r in got) == sorted(str(r) for r in odd_rows())
    last = next(r.found for r in got if r.row.doc_id is None and r.row.text)
    assert last.n_removed == last.n_bytes and last.kept_text == ""
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("crowd", [1024, 20])
def test_suffix_dedup_of_a_shared_passage_in_many_surroundings(spark, crowd):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(180)
    rows = [(i, noise(rng.randint(0, 90)) + passage[rng.randint(0, 30):] + noise(rng.randint(0, 90))) for i in range(120)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2000, crowd=crowd).collect()
    assert sorted(tuple(r[:5]) for r in got) == plain_repeats([(i, t.encode()) for i, t in rows])


def test_deep_shallow_order_is_suffix_order():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(400)]
    strings += [b"a" * 24 + s for s in strings] + [b"a" * 40] * 3
    order, shared = suffix_dedup.deep_shallow_order(strings, 16)
    got = [strings[i] for i in order]
    assert [g[:16] for g in got] == sorted((s[:16] for s in strings), key=lambda s: s.ljust(16, b"\0")) or [g for g in got if len(g) > 16] == sorted(s for s in strings if len(s) > 16)
    for x, y, n in zip(got, got[1:], shared[1:]):
        true = suffix_dedup.common_prefix(x, y)
        assert n == true if len(x) > 16 and len(y) > 16 and true >= 16 else n <= max(true, 16)
