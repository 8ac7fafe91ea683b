"""Exact removal of repeated byte strings over a whole corpus, by a sparse suffix array with deep-shallow sorting.

Every string of `length` bytes holds anchors: positions whose 32-byte hash is least among the 32-grams of the string. The
leftmost of them is the string's own anchor, so equal strings share an anchor at the same distance, and consecutive strings
with one anchor form a run. Texts are split into blocks (hash of the id), and the work goes in four shuffles:

1. every block sends the hashes of its runs (anchor, whole run) to buckets by anchor;
2. a bucket answers for each run: nothing repeats, all of it is an earlier run again, or its anchor occurs in other surroundings;
3. only the runs in the last case are sent with their bytes, by anchor, one for each different run. The suffixes that begin at
   their anchors, and the mirrored prefixes that end there, are sorted: multikey quicksort by eight-byte words to a shallow
   depth, then blind tries for groups with longer common prefixes. The common-prefix lengths of both orders give, for every
   distance to the anchor, classes of equal strings; all but the first of a class go;
4. blocks apply the answers to their texts.

An anchor with very many different surroundings isn't gathered: the strings of its runs go one by one, by a digest of each, and
every block sends only its first of equal ones.

Hashes only say which runs to compare; runs that are equal as a whole are told by 128 bits of two hashes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeproof.llm.common import as_bytes

LENGTH, GRAM, BLOCK_BYTES = 100, 32, 1 << 20
CROWD = 1024
ONCE, AGAIN, MIXED, SPLIT = 0, 1, 2, 3
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * B


def gram_hashes(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of `size` and of 2 * `size` bytes (`size` a power of two), each from its two halves."""
    h, width = _mixed(data.astype(np.uint64) + A), 1
    while True:
        doubled = _mixed(h[:-width] * A + (h[width:] ^ (h[width:] >> np.uint64(32)))) if len(h) > width else h[:0]
        if width == size:
            return h, doubled
        h, width = doubled, 2 * width


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[i : i + width] for every i where that is whole."""
    done = 1
    while 2 * done <= width:
        h, done = np.minimum(h[:-done], h[done:]), 2 * done
    return np.minimum(h[: len(h) - (width - done)], h[width - done:]) if done < width else h


class Runs:
    """The runs of a block: strings start..last share the anchor; doc is the text's number in the block."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.end = self.begin + sizes
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.length, self.gram = length, gram
        self.start = self.last = self.anchor = self.doc = np.zeros(0, dtype=np.int64)
        self.hash = self.whole = np.zeros(0, dtype=np.uint64)
        long = np.flatnonzero(sizes >= length)
        if not len(long):
            self.first = np.zeros(0, dtype=np.int64)
            return
        span = length - gram + 1
        h, doubled = gram_hashes(self.data, gram)
        self.doubled = doubled
        least = sliding_min(h, span)
        fresh = np.ones(len(least), dtype=bool)
        fresh[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
        fresh[self.begin[long]] = True
        change = np.zeros(len(least) + 1, dtype=np.int8)
        change[self.begin[long]] += 1
        change[self.end[long] - length + 1] -= 1
        fresh &= np.cumsum(change[:-1], dtype=np.int8) > 0
        self.start = np.flatnonzero(fresh)
        self.doc = np.searchsorted(self.begin, self.start, side="right") - 1
        self.last = np.minimum(np.r_[self.start[1:], len(least)] - 1, self.end[self.doc] - length)
        self.anchor = self.start.copy()
        reach = np.arange(span)
        for i in range(0, len(self.start), 8192):
            part = self.start[i:i + 8192]
            self.anchor[i:i + 8192] += h[part[:, None] + reach].argmin(axis=1)
        self.hash = h[self.anchor]
        stop, two = self.last + length - 2 * gram, 2 * gram
        self.whole = _mixed(_mixed(doubled[self.start] + (stop - self.start).astype(np.uint64)) + doubled[np.minimum(self.start + two, stop)] * C)
        self.whole = _mixed(self.whole + doubled[stop] * A)
        _, self.first = np.unique(_mixed(self.hash * C + self.whole), return_index=True)
        self.first.sort()

    def strings(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All strings of some runs: run, where it starts, 128 bits of hashes as two columns, and whether it is the block's first."""
        n = self.last[runs] - self.start[runs] + 1
        run = np.repeat(runs, n)
        start = np.repeat(self.start[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        digest = np.column_stack([self.doubled[start], self.doubled[start + self.length - 2 * self.gram]])
        order = np.lexsort((start, digest[:, 1], digest[:, 0]))
        first = np.zeros(len(start), dtype=bool)
        first[order] = np.r_[True, (digest[order][1:] != digest[order][:-1]).any(axis=1)]
        return run, start, digest, first

    def bucket(self, buckets: int) -> np.ndarray:
        """Of the runs in `first`."""
        return ((_mixed(self.hash[self.first] * A) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _in_order(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Row numbers of a block by (order, text), and the texts in this order."""
    order, texts = table["o"].to_pylist(), as_bytes(table["t"])
    rows = sorted(range(len(texts)), key=lambda i: (order[i], texts[i]))
    return rows, [texts[i] for i in rows]


def _send(buckets: int, key: tuple, table: pa.Table) -> pa.Table:
    rows, texts = _in_order(table)
    runs = Runs(texts)
    order = np.array(table["o"].to_pylist(), dtype=np.int64)[rows][runs.doc[runs.first]]
    bucket = runs.bucket(buckets)
    by = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[by], return_index=True)
    out = [[], [], []]
    for part in np.split(by, begin[1:]) if len(found) else []:
        at = runs.first[part]
        for column, values in zip(out, (runs.hash[at], runs.whole[at], order[part])):
            column.append(values.tobytes())
    return pa.table({"k": pa.array(found, pa.int64()), "b": pa.array([key[0].as_py()] * len(found), pa.int64()), "hash": pa.array(out[0], pa.binary()), "whole": pa.array(out[1], pa.binary()), "ord": pa.array(out[2], pa.binary())})


def _answer(crowd: int, key: tuple, table: pa.Table) -> pa.Table:
    joined = [b"".join(table[c].to_pylist()) for c in ("hash", "whole", "ord")]
    h, whole = (np.frombuffer(x, dtype=np.uint64) for x in joined[:2])
    order = np.frombuffer(joined[2], dtype=np.int64)
    status = np.full(len(h), ONCE, dtype=np.uint8)
    by = np.argsort(h)
    same = np.zeros(len(h) + 1, dtype=bool)
    same[1:-1] = h[by][1:] == h[by][:-1]
    some = by[same[1:] | same[:-1]]
    if len(some):
        some = some[np.lexsort((order[some], whole[some], h[some]))]
        anchor = np.r_[True, h[some][1:] != h[some][:-1]]
        kind = anchor | np.r_[True, whole[some][1:] != whole[some][:-1]]
        kinds = np.add.reduceat(kind, np.flatnonzero(anchor), dtype=np.int64)[np.cumsum(anchor) - 1]
        status[some] = np.where(~kind, AGAIN, np.where(kinds > crowd, SPLIT, np.where(kinds > 1, MIXED, ONCE)))
    ends = np.cumsum([len(x) // 8 for x in table["hash"].to_pylist()])
    return pa.table({"b": table["b"], "k": table["k"], "kind": pa.array([0] * len(ends), pa.int32()), "x": pa.array([s.tobytes() for s in np.split(status, ends[:-1])], pa.binary()), "y": pa.array([b""] * len(ends), pa.binary())})


def _statuses(runs: Runs, buckets: int, answers: pa.Table) -> np.ndarray:
    """One for each run of the block, from the answers of all buckets."""
    status = np.full(len(runs.start), AGAIN, dtype=np.uint8)
    if len(runs.first):
        got = sorted((k, x) for k, x, kind in zip(answers["k"].to_pylist(), answers["x"].to_pylist(), answers["kind"].to_pylist()) if kind == 0)
        status[runs.first[np.argsort(runs.bucket(buckets), kind="stable")]] = np.frombuffer(b"".join(x for _, x in got), dtype=np.uint8)
    return status


def _surroundings(buckets: int, key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
    rows, texts = _in_order(table)
    runs = Runs(texts)
    status = _statuses(runs, buckets, answers)
    order = np.array(table["o"].to_pylist(), dtype=np.int64)[rows]
    at = np.flatnonzero(status == MIXED)
    data = runs.data.tobytes()
    columns = [
        [runs.hash[at].view(np.int64), at, order[runs.doc[at]], runs.anchor[at] - runs.start[at]]]
    sent = [data[s:e] for s, e in zip(runs.start[at].tolist(), (runs.last[at] + LENGTH).tolist())]
    crowded = np.flatnonzero(status == SPLIT)
    if len(crowded):
        run, start, digest, first = runs.strings(crowded)
        run, start, digest = run[first], start[first], np.ascontiguousarray(digest[first])
        columns.append([_mixed(digest[:, 0] * C + digest[:, 1]).view(np.int64), run, order[runs.doc[run]], start - runs.anchor[run] - 1])
        raw = digest.tobytes()
        sent += [raw[16 * i:16 * i + 16] for i in range(len(run))]
    anchor, run, ranks, lead = (np.concatenate(x) for x in zip(*columns))
    return pa.table({
        "anchor": pa.array(anchor), "b": pa.array([key[0].as_py()] * len(run), pa.int64()), "run": pa.array(run, pa.int64()),
        "ord": pa.array(ranks, pa.int64()), "lead": pa.array(lead, pa.int32()), "bytes": pa.array(sent, pa.binary())})


def shallow_order(words: np.ndarray, small: int = 4096) -> list[np.ndarray]:
    """Rows by their words: three-way quicksort on one word after another, small parts at once; groups of equal rows, in order."""
    groups, todo = [], [(np.arange(len(words)), 0)]
    while todo:
        rows, k = todo.pop()
        if not len(rows):
            continue
        if k == words.shape[1]:
            groups.append(rows)
        elif len(rows) <= small:
            rows = rows[np.lexsort(words[rows, k:].T[::-1])]
            groups += np.split(rows, np.flatnonzero((words[rows][1:] != words[rows][:-1]).any(axis=1)) + 1)
        else:
            column = words[rows, k]
            pivot = np.sort(column[[0, len(rows) // 2, -1]])[1]
            todo += [(rows[column > pivot], k), (rows[column == pivot], k + 1), (rows[column < pivot], k)]
    return groups


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before (0 for the first). A prefix comes first.

    Inner nodes are [depth, children by next byte, -1 where a string ends]; a leaf is a list of equal strings' numbers.
    """
    at = lambda s, d: s[d] if d < len(s) else -1
    root: tuple | list = [0]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, tuple):
            node = node[1].get(at(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node.append(i)
            continue
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < same:
            parent, node = node, node[1][at(s, node[0])]
        if isinstance(node, tuple) and node[0] == same:
            node[1][at(s, same)] = [i]
            continue
        fork = (same, {at(s, same): [i], at(other, same): node})
        if parent is None:
            root = fork
        else:
            parent[1][at(s, parent[0])] = fork
    order: list[int] = []
    prefixes: list[int] = []
    todo = [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if isinstance(node, tuple):
            children = [node[1][k] for k in sorted(node[1])]
            todo += [(c, node[0]) for c in reversed(children[1:])]
            todo.append((children[0], shared))
        else:
            order += node
            prefixes += [shared] + [len(strings[node[0]])] * (len(node) - 1)
    return order, prefixes


def deep_shallow_order(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each with the one before; under `depth` bytes it is given as 0."""
    width = depth // 8
    heads = np.frombuffer(b"".join(s[:depth].ljust(depth, b"\0") for s in strings), dtype=">u8").reshape(-1, width).astype(np.uint64)
    order, prefixes = [], []
    for group in shallow_order(heads):
        if len(group) == 1:
            order.append(group)
            prefixes.append(np.zeros(1, dtype=np.int64))
        else:
            inner, shared = blind_trie_order([strings[i] for i in group])
            order.append(group[inner])
            prefixes.append(np.array(shared, dtype=np.int64))
    return np.concatenate(order), np.concatenate(prefixes)


def repeated_strings(anchor: np.ndarray, lead: np.ndarray, runs: list[bytes], rank: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For runs around anchors: which of the strings at distance 0, 1, ... before the anchor occurs in a run of lower rank."""
    n, span = len(runs), length - gram + 1
    size = np.array([len(r) for r in runs], dtype=np.int64)
    heads = anchor.astype(">u8").tobytes()
    right, right_shared = deep_shallow_order([r[k:k + length] for r, k in zip(runs, lead.tolist())], gram)
    left, left_shared = deep_shallow_order([heads[8 * i:8 * i + 8] + r[:k][::-1] for i, (r, k) in enumerate(zip(runs, lead.tolist()))], 8)
    gone = np.zeros((n, span), dtype=bool)
    by_rank = np.argsort(rank)
    classes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for d in range(span):
        classes[0][left] = np.cumsum(left_shared < 8 + d)
        classes[1][right] = np.cumsum(right_shared < length - d)
        there = by_rank[(lead[by_rank] >= d) & (lead[by_rank] - d <= size[by_rank] - length)]
        _, first = np.unique(classes[0][there] * (n + 1) + classes[1][there], return_index=True)
        again = np.ones(len(there), dtype=bool)
        again[first] = False
        gone[there[again], d] = True
    return gone


def _compare(batches):
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    block, run, order, lead = (table[c].to_numpy() for c in ("b", "run", "ord", "lead"))
    rank = np.empty(len(run), dtype=np.int64)
    rank[np.lexsort((run, block, order))] = np.arange(len(run))
    whole, single = np.flatnonzero(lead >= 0), np.flatnonzero(lead < 0)
    gone = np.zeros((len(run), LENGTH - GRAM + 1), dtype=bool)
    if len(whole):
        part = table.take(pa.array(whole))
        gone[whole] = repeated_strings(part["anchor"].to_numpy().view(np.uint64), lead[whole], part["bytes"].to_pylist(), rank[whole])
    if len(single):
        digest = np.frombuffer(b"".join(table["bytes"].take(pa.array(single)).to_pylist()), dtype=np.uint64).reshape(-1, 2)
        by = np.lexsort((rank[single], digest[:, 1], digest[:, 0]))
        again = single[by][np.r_[False, (digest[by][1:] == digest[by][:-1]).all(axis=1)]]
        gone[again, -1 - lead[again]] = True
    gone = np.packbits(gone, axis=1)
    some = np.flatnonzero(gone.any(axis=1))
    some = some[np.argsort(block[some], kind="stable")]
    blocks, begin = np.unique(block[some], return_index=True)
    groups = np.split(some, begin[1:]) if len(blocks) else []
    yield pa.RecordBatch.from_arrays([
        pa.array(blocks, pa.int64()), pa.array([0] * len(blocks), pa.int64()), pa.array([1] * len(blocks), pa.int32()),
        pa.array([run[g].tobytes() for g in groups], pa.binary()), pa.array([gone[g].tobytes() for g in groups], pa.binary())], ["b", "k", "kind", "x", "y"])


def _removed(runs: Runs, buckets: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the removed stretches in the block's bytes; they may overlap and follow no order."""
    status = _statuses(runs, buckets, answers)
    again, crowded = np.flatnonzero(status == AGAIN), np.flatnonzero(status == SPLIT)
    begin, end = [runs.start[again]], [runs.last[again] + LENGTH]
    if len(crowded):
        _, start, _, first = runs.strings(crowded)
        begin.append(start[~first])
        end.append(start[~first] + LENGTH)
    for x, y, kind in zip(answers["x"].to_pylist(), answers["y"].to_pylist(), answers["kind"].to_pylist()):
        if kind == 1:
            at = np.frombuffer(x, dtype=np.int64)
            which, d = np.nonzero(np.unpackbits(np.frombuffer(y, dtype=np.uint8).reshape(len(at), -1), axis=1))
            begin.append(runs.anchor[at[which]] - d)
            end.append(begin[-1] + LENGTH)
    return np.concatenate(begin), np.concatenate(end)


def _cut(buckets: int, carried: int, with_text: bool, schema: pa.Schema, key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
    rows, texts = _in_order(table)
    runs = Runs(texts)
    begin, end = _removed(runs, buckets, answers)
    change = np.zeros(len(runs.data) + 1, dtype=np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    gone = np.zeros(len(runs.data) + 2, dtype=np.int8)
    gone[1:-1] = np.cumsum(change[:-1]) > 0
    step = np.diff(gone)
    edges = np.unique(np.concatenate([np.flatnonzero(step), runs.begin]))
    edges = edges[edges < len(runs.data)]
    inside = gone[1:-1][edges] > 0
    stops = np.r_[edges[1:], len(runs.data)]
    spans = list(zip(edges[inside].tolist(), stops[inside].tolist()))
    doc = (np.searchsorted(runs.begin, edges[inside], side="right") - 1).tolist()
    by_doc: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, (s, e) in zip(doc, spans):
        by_doc[d].append((s - int(runs.begin[d]), e - int(runs.begin[d])))
    kept = []
    for text, cuts in zip(texts, by_doc):
        at = [0, *(x for cut in cuts for x in cut), len(text)]
        kept.append(b"".join(text[s:e] for s, e in zip(at[::2], at[1::2])))
    columns = [table[f"c{i}"].take(pa.array(rows, pa.int64())) for i in range(carried)]
    columns += [
        pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(e - s for s, e in cuts) for cuts in by_doc], pa.int64()),
        pa.array([len(cuts) for cuts in by_doc], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        pa.array([[{"begin": s, "end": e} for s, e in cuts] for cuts in by_doc], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
    if with_text:
        columns.append(pa.array([k.decode(errors="ignore") for k in kept], pa.string()))
    return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=list(schema.names))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, with_text: bool = False,
    block_bytes: int = BLOCK_BYTES, crowd: int = CROWD,
) -> DataFrame:
    """The id, n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked for, kept_text.

    With `carry` columns the result is (row, found): two structs, so that no names can clash.

    A byte goes if a 100-byte string over it also starts earlier: in a row with a smaller id, or earlier in the same text.
    Rows with one id come in the order of their texts; null ids come last, in the order of a hash of the text. A null text
    is empty. kept_text leaves out the halves of characters that a cut splits. An empty table gives an empty result.
    """
    carry, wide = [id_col] if carry is None else carry, carry is not None
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(blocks // 8, min(blocks, 64))
    order = F.coalesce(own, F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2))
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], text.alias("t"), order.alias("o"), F.pmod(F.xxhash64(order), F.lit(blocks)).alias("b"))
    types = [T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    spans = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([
        *types, *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", spans), *([T.StructField("kept_text", T.StringType())] if with_text else [])])
    by_block = rows.groupBy("b")
    sent = by_block.applyInArrow(_keyed(_send, buckets), "k long, b long, hash binary, whole binary, ord binary")
    answers = sent.groupBy("k").applyInArrow(_keyed(_answer, crowd), "b long, k long, kind int, x binary, y binary")
    mixed = by_block.cogroup(answers.groupBy("b")).applyInArrow(
        _cokeyed(_surroundings, buckets), "anchor long, b long, run long, ord long, lead int, bytes binary")
    compared = mixed.repartition("anchor").mapInArrow(_compare, "b long, k long, kind int, x binary, y binary")
    names = pa.schema([(f.name, pa.null()) for f in out])
    cut = by_block.cogroup(answers.unionByName(compared).groupBy("b")).applyInArrow(_cokeyed(_cut, buckets, len(carry), with_text, names), out)
    row, found = [F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], [f.name for f in out][len(carry):]
    return cut.select(F.struct(*row).alias("row"), F.struct(*found).alias("found")) if wide else cut.select(*row, *found)


def _keyed(function, *args):
    bound = partial(function, *args)
    return lambda key, table: bound(key, table)


def _cokeyed(function, *args):
    bound = partial(function, *args)
    return lambda key, left, right: bound(key, left, right)
