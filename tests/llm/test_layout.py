"""Sharding, packing, mixing and archives: their laws, round trips and odd rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeproof.llm import hilbert, mixing, packing, warc
from placeproof.llm.common import shared_folder

ODD = [(1, None, "en", "s", "x"), (2, "", None, None, "x"), (3, "a b c", "en", "s", None), (3, "a b c", "en", "s", "x"), (None, "ü " * 5, "de", "t", "x"), (4, "w " * 30000, "en", "s", "x"), (5, "a b c", "en", "s", "x")]
SCHEMA = "doc_id long, text string, lang string, source string, curve string"


@pytest.mark.parametrize("dims, bits", [(2, 5), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert.curve_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("copies, group_rows", [(1, 1 << 16), (23, 8)])
def test_shards_are_equal_runs_of_the_curve(spark, copies, group_rows):
    rows = [(None if r[0] is None else r[0] + 10 * i, *r[1:]) for i in range(copies) for r in ODD]
    got = hilbert.shard(spark.createDataFrame(rows, SCHEMA), hilbert.text_dimensions(F.col("text")), group_rows=group_rows).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - (min(counts.values()) if len(rows) >= 16 else 0) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_sharding_an_empty_table(spark):
    assert hilbert.shard(spark.createDataFrame([], SCHEMA), hilbert.text_dimensions(F.col("text"))).collect() == []


def test_packing_keeps_every_token_once(spark):
    rng = random.Random(3)
    rows = [*ODD, *[(100 + i, "w " * rng.choice([1, 5, 90, 300, 511, 700]), "en", "s", "") for i in range(400)]]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), packing.words(F.col("text")), lengths=(512, 128, 1024), group_pieces=100).collect()
    size = Counter()
    for r in rows:
        size[r[0]] += len((r[1] or "").split())
    assert {k: sum(r.n_tokens for r in got if r.doc_id == k) for k in size} == dict(size)
    bins = defaultdict(list)
    for r in got:
        if r.bin_id is None:
            assert (r.n_tokens, r.bin_length) == (0, 0)
        else:
            bins[r.bin_id].append(r)
    for inside in bins.values():
        full = sum(r.n_tokens for r in inside)
        assert {r.bin_length for r in inside} == {min(c for c in (128, 512, 1024) if c >= full)}
        at = 0
        for r in sorted(inside, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
    assert packing.pack(spark.createDataFrame([], SCHEMA), packing.words(F.col("text"))).collect() == []


def test_best_fit_against_a_plain_one():
    """The same choices by looking at every open bin."""
    rng = random.Random(5)
    lengths, overhead = (64, 128, 256), 4
    sizes = sorted((rng.randint(1, 256) for _ in range(300)), reverse=True)
    bins, offsets, capacity = packing.best_fit(sizes, lengths, overhead)
    rooms, content = [], []
    for i, s in enumerate(sizes):
        fitting = [b for b in range(len(rooms)) if rooms[b] >= s]
        if fitting:
            assert rooms[bins[i]] == min(rooms[b] for b in fitting)
        else:
            assert bins[i] == len(rooms)
            costs = {}
            for c in (c for c in lengths if c >= s):
                left, used, rest, steps, last = c - s, 0, sizes[i + 1:], 0, None
                for x in rest:
                    if x <= left - used and (x == last or steps < packing.LOOK_AHEAD):
                        steps += x != last
                        used, last = used + x, x
                costs[c] = (c + overhead) / (s + used)
            rooms.append(min(costs, key=lambda c: (costs[c], c)))
            content.append(0)
        b = bins[i]
        assert offsets[i] == content[b]
        rooms[b] -= s
        content[b] += s
    assert capacity == [min(c for c in lengths if c >= n) for n in content]


def test_raking_meets_the_marginals_and_the_budget():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, (5, 4, 3)).astype(float)
    aims = [rng.dirichlet(np.ones(n)) for n in tokens.shape]
    weights = mixing.rake(tokens, aims, 60)
    for axis, aim in enumerate(aims):
        assert np.allclose(weights.sum(axis=tuple(a for a in range(3) if a != axis)), aim, atol=1e-6)
    for share in (0.1, 0.7, 1.0):
        chance = mixing.calibrate(tokens.ravel(), weights.ravel(), share * tokens.sum())
        assert np.isclose((chance * tokens.ravel()).sum(), share * tokens.sum()) and chance.max() <= 1
        part = chance < 1
        assert np.allclose((chance * tokens.ravel() / weights.ravel())[part], (chance * tokens.ravel() / weights.ravel())[part].mean() if part.any() else 0)


def test_mixing_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    run = lambda d: mixing.mix(d, {"lang": F.col("lang"), "curve": F.col("source")}, {"lang": {"en": 0.5, "*": 0.5}, "curve": {"s": 1.0}}, packing.words(F.col("text")), 0.5).collect()
    got = run(df)
    assert len(got) == len(ODD) and all(0 <= r.probability <= 1 for r in got)
    assert len({r.kept for r in got if r.doc_id == 3}) == 1
    assert run(df.limit(0)) == [] and {r.probability for r in run(df.where("doc_id < 3"))} == {0.5}


def digest(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def test_archive_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>", 0), (2, "http://b", "<p>x</p>", 0), (9, None, "<p>x</p>", 0), (3, "http://c", None, 0), (4, "http://d\r\nX: y", "", 0), (5, "u", "é" * 9000, 0), (5, "u", "é" * 9000, 0), (None, "n", "<p>x</p>", 0), (None, "n", "alone", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(df, folder)
    body = lambda r: (r[2] or "").encode()
    head = {}
    for r in rows:
        if r[0] is not None:
            head[body(r)] = max(head.get(body(r), r[0]), r[0])
    want = sorted(str((r[0], len(body(r)), digest(body(r)), "response" if r[0] == head.get(body(r)) else "revisit", None if r[0] == head.get(body(r)) else head.get(body(r)), True)) for r in rows)
    assert sorted(str(tuple(r[:6])) for r in warc.read_archive(spark, folder).collect()) == want
    assert spark.read.parquet(f"{folder}/payloads").count() == len({body(r) for r in rows})
    for page, record in warc.restore(spark, folder).collect():
        header, rest = bytes(record).split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in header.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert rest[len(block):] == b"\r\n\r\n" and header.startswith(b"WARC/1.1")
        payload = block.split(b"\r\n\r\n", 1)[1]
        if fields[b"WARC-Type"] == b"response":
            assert digest(payload).encode() == fields[b"WARC-Payload-Digest"][5:] and head.get(payload) == page
        else:
            assert payload == b"" and fields[b"WARC-Refers-To"].startswith(b"<urn:page:")


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx"), (3, "a", "long one"), (4, "a", "long one")], "page_id long, url string, html string")
    assert {r.page_id: r.record_type for r in warc.archived(df, least_bytes=3).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archived(df.limit(0)).collect() == []


def test_groups_are_bounded_by_pieces(spark):
    """Neither long texts nor one id that holds all rows fill a group."""
    long = spark.createDataFrame([(i, 400 * packing.LENGTHS[-1]) for i in range(50)], "doc_id long, n long")
    same = spark.createDataFrame([(None, 7)] * 20000, "doc_id long, n long")
    for rows in (long, same):
        got = packing.pack(rows, F.col("n"), group_pieces=100).groupBy((F.col("bin_id").bitwiseAND(F.lit(-1 << 32))).alias("g")).count().collect()
        assert max(r["count"] for r in got) < 200 and sum(r["count"] for r in got) == 20000
