"""Exact BM25 top-k: one index a tile of documents, bounded by block maxima, with global statistics.

Document frequencies, the number of rows and their mean length are taken over the whole table, so a score doesn't depend on the
shard. A task holds queries, and its shard's documents stream through it, tile by tile, as bags of words; so queries are copied once a
shard, and shards grow when there are many. The best rows of a query are kept from tile to tile. A tile is cut into blocks of
texts that have common words in common; queries are ordered alike. What a query's words can add up to in a block says whether it is passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.llm.common import as_bytes, stored

K1, B, TOP, SHARD_DOCS, KEPT_WORDS = 1.2, 0.75, 10, 1 << 13, 1 << 16
# Shards beyond which they grow with the table, up to how many times; words of the queries that a task holds.
SHARDS, GROWN, ASKED_WORDS = 36, 32, 3 << 22
# Rows and words of a tile, rows of a block, queries of a batch, common words and groups that tell which texts are alike. A word of a
# batch is multiplied if a DENSE-th of the rows has it and it occurs in more than a GAIN-th of the pairs.
TILE, TILE_WORDS, BLOCK, BATCH, PASS, COMMON, CENTRES, DENSE, GAIN = 1 << 11, 1 << 20, 1 << 11, 256, 16, 128, 16, 64, 250
WORD = re.compile(r"\w+")


class Words:
    """64-bit numbers of words; remembers those it has met."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def bag(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Sorted numbers of the words, and how often each occurs."""
        counts = Counter(WORD.findall(text.decode(errors="replace").lower()))
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        for w in counts:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode(errors="replace")) - (1 << 63)
        terms = np.fromiter(map(known.__getitem__, counts), dtype=np.int64, count=len(counts))
        order = np.argsort(terms)
        return terms[order], np.fromiter(counts.values(), dtype=np.int32, count=len(counts))[order]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        found = [words.bag(t) for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array([int(c.sum()) for _, c in found], pa.int64()), pa.array([t.tobytes() for t, _ in found], pa.binary()),
            pa.array([c.tobytes() for _, c in found], pa.binary())], ["id", "size", "terms", "counts"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the task's rows each word occurs, and as word null: rows and words."""
    rows, size, held = 0, 0, 0
    waiting: list[np.ndarray] = []

    def summed() -> pa.RecordBatch:
        terms, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), dtype=np.int64))], ["term", "n", "words"])

    for batch in batches:
        waiting.append(np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype=np.int64))
        rows, size, held = rows + batch.num_rows, size + int(np.sum(batch.column("size").to_numpy())), held + len(waiting[-1])
        if held > 1 << 21:
            yield summed()
            waiting, held = [], 0
    if waiting:
        yield summed()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], ["term", "n", "words"])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def _flat(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Asked:
    """A group of queries and the best rows each has met so far; rows are added tile by tile.

    A tile is cut into blocks of rows alike. A block has the postings of all words that are asked and their maxima, so a query passes over
    it if what its words can add up to there is less than its k-th score. What many queries and many rows have in common is a
    matrix product; other words are added up from their postings. Both are near sums, of which those within their
    error of the k-th are added up exactly, in one order wherever a row lies: rows of equal words have equal scores.
    """

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray], rows: list[np.ndarray], total: int, mean: float, k: int):
        lengths = np.array([len(t) for t in terms], dtype=np.int64)
        self.mean, self.k, n = mean, k, len(ids)
        some = range(0, n, BATCH)
        self.words = np.unique(np.concatenate([np.unique(np.concatenate(terms[i:i + BATCH])) for i in some]))
        at = np.concatenate([np.searchsorted(self.words, np.concatenate(terms[i:i + BATCH])).astype(np.int32) for i in some])
        self.mask = (1 << (2 * len(self.words)).bit_length()) - 1
        slot = self.words & self.mask
        self.table, self.crowded = np.zeros(self.mask + 1, dtype=np.int32), np.bincount(slot, minlength=self.mask + 1) > 1
        self.table[slot] = np.arange(len(self.words))
        self.weight = np.zeros(len(self.words))
        self.weight[at] = np.concatenate(rows)
        self.weight = np.log(1 + (total - self.weight + 0.5) / (self.weight + 0.5))
        common = np.argsort(-np.bincount(at, minlength=len(self.words)), kind="stable")[:COMMON]
        self.column = np.full(len(self.words), -1, dtype=np.int16)
        self.column[common] = np.arange(len(common))
        pattern = self._pattern(np.repeat(np.arange(n, dtype=np.int32), lengths), at, n)
        self.centres = pattern[np.linspace(0, n - 1, min(n, CENTRES)).astype(np.int64)]
        for _ in range(4):
            near = np.argmax(pattern @ self.centres.T, axis=1)
            self.centres = _unit(np.stack([pattern[near == c].sum(axis=0) for c in range(len(self.centres))]))
        near = np.argmax(pattern @ self.centres.T, axis=1)
        order = np.lexsort((lengths, near))
        self.ids, begin = ids[order], (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        self.slack = (lengths + 16) * 2.0 ** -22
        self.batches = []
        for low in range(0, n, BATCH):
            size = lengths[low:low + BATCH]
            words, where, times = np.unique(at[_flat(begin[low:low + BATCH], size)], return_inverse=True, return_counts=True)
            self.batches.append((low, words, where.astype(np.int32), times.astype(np.int32), np.repeat(np.arange(len(size), dtype=np.int16), size)))
        self.by_id = np.argsort(self.ids, kind="stable")
        self.best, self.best_id = np.zeros((n, k)), np.zeros((n, k), dtype=np.int64)
        self.begin, self.size, self.row = (np.zeros(len(self.words), dtype=np.int32) for _ in range(3))
        self.most = np.zeros(len(self.words))

    def _pattern(self, owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Which common words a text has, as a vector of length one."""
        column = self.column[at]
        pattern = np.zeros((n, COMMON), dtype=np.float32)
        pattern[owner[column >= 0], column[column >= 0]] = 1
        return _unit(pattern)

    def add(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> None:
        slot = terms & self.mask
        at = self.table[slot]
        unsure = np.flatnonzero(self.crowded[slot])
        at[unsure] = np.searchsorted(self.words, terms[unsure]).clip(max=len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == terms)
        at, counts, row = at[hit], counts[hit].astype(np.float64), np.repeat(np.arange(len(ids), dtype=np.int32), lengths)[hit]
        near = np.argmax(self._pattern(row, at, len(ids)) @ self.centres.T, axis=1)
        order = np.lexsort((sizes, near))
        place = np.empty(len(ids), dtype=np.int32)
        place[order] = np.arange(len(ids))
        doc = place[row]
        value = self.weight[at] * (counts * (K1 + 1) / (counts + K1 * (1 - B + B * sizes[row] / max(self.mean, 1e-9))))
        by = np.argsort(doc // BLOCK * len(self.words) + at)
        low_value = value.astype(np.float32)
        cuts = np.searchsorted(doc[by] // BLOCK, np.arange(-(-len(ids) // BLOCK) + 1))
        near, likely = self.best.copy(), []
        for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
            if low < high:
                some = by[low:high]
                self._block(ids[order[i * BLOCK:(i + 1) * BLOCK]], (doc[some] - i * BLOCK).astype(np.int16), at[some], low_value[some], near, likely, i * BLOCK)
        if likely:
            query, doc, score = map(np.concatenate, zip(*likely))
            self._take(ids, at, value, np.searchsorted(row, np.arange(len(ids) + 1)), near, query, order[doc], score)

    def _block(self, ids, doc, at, value, near, likely, first) -> None:
        """`at`, sorted, and `value`: the words of the block's rows, and what each adds to a score. `near`: the best near sums up to here;
        `likely` gets what may be among the best, as queries, rows (from `first` on) and near sums."""
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words, size = at[starts], np.diff(np.r_[starts, len(at)])
        self.begin[words], self.size[words], self.most[words] = starts, size, np.maximum.reduceat(value, starts)
        heavy = np.flatnonzero(size >= BLOCK // DENSE)
        self.row[words[heavy]] = np.arange(len(heavy))
        dense = np.zeros((len(heavy), BLOCK), dtype=np.float32)
        posting = _flat(starts[heavy], size[heavy])
        dense[np.repeat(np.arange(len(heavy)), size[heavy]), doc[posting]] = value[posting]
        own = np.searchsorted(self.ids[self.by_id], ids).clip(max=len(self.ids) - 1)
        own = np.where(self.ids[self.by_id[own]] == ids, self.by_id[own], -1)
        for low, asked, where, times, query in self.batches:
            n = min(BATCH, len(self.ids) - low)
            there, least = self.size[asked], near[low:low + n, -1]
            bound = np.bincount(query, weights=self.most[asked][where], minlength=n)
            open_ = (bound > 0) & (bound >= least * (1 - self.slack[low:low + n]))
            if not open_.any():
                continue
            use = open_[query]
            dealt = np.flatnonzero((there >= BLOCK // DENSE) & (there * times.astype(np.int64) * GAIN >= BLOCK * n))
            turn = np.full(len(asked), -1, dtype=np.int32)
            turn[dealt] = np.arange(len(dealt))
            turn[there == 0] = -2
            kind = turn[where]
            lone = np.flatnonzero(use & (kind == -1))
            word = where[lone]
            run, start = there[word], self.begin[asked][word]
            score = np.empty((n, BLOCK))
            cuts = np.searchsorted(query[lone], np.arange(0, n + PASS, PASS))
            for i, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:])):  # few queries a pass, so that its arrays stay in the cache
                size = run[begin:end]
                spot = _flat(start[begin:end], size)
                to = score[i * PASS:(i + 1) * PASS]
                to[:] = np.bincount(np.repeat((query[lone[begin:end]] - i * PASS) * np.int64(BLOCK), size) + doc[spot], weights=value[spot], minlength=to.size).reshape(to.shape)
            if len(dealt):
                shared = np.flatnonzero(use & (kind >= 0))
                wants = np.zeros((n, len(dealt)), dtype=np.float32)
                wants[query[shared], kind[shared]] = 1
                score += wants @ dense[self.row[asked[dealt]]]
            mine = np.flatnonzero((own >= low) & (own < low + n))
            score[own[mine] - low, mine] = 0
            self._choose(low, score, near, likely, first)
        self.size[words], self.most[words] = 0, 0

    def _choose(self, low: int, score: np.ndarray, near: np.ndarray, likely: list, first: int) -> None:
        slack, least = self.slack[low:low + len(score)], near[low:low + len(score), -1]
        top = score.max(axis=1)
        active = np.flatnonzero((top > 0) & (top >= least * (1 - 2 * slack)))
        if not len(active):
            return
        part, slack, least = score[active], slack[active], least[active]
        group = part.reshape(len(active), -1, 16).max(axis=2)
        if self.k <= group.shape[1]:
            least = np.maximum(least, np.partition(group, -self.k, axis=1)[:, -self.k])
        q, d = np.nonzero((part >= (least * (1 - 2 * slack))[:, None]) & (part > 0))
        value, q, active = part[q, d], active[q] + low, active + low
        likely.append((q, d + first, value))
        owner, value = np.r_[np.repeat(active, self.k), q], np.r_[near[active].ravel(), value]
        order = np.lexsort((-value, owner))
        near[active] = value[order[np.searchsorted(owner[order], active)[:, None] + np.arange(self.k)]]

    def _take(self, ids, at, value, held, near, query, doc, score) -> None:
        """Takes up the rows of the tile that are among the best; `at` and `value` are sorted by row, those of a row begin at `held`."""
        some = np.flatnonzero(score >= near[query, -1] * (1 - 2 * self.slack[query]))
        some = some[np.argsort(query[some], kind="stable")]
        query, doc = query[some], doc[some]
        asks = np.zeros(len(self.words), dtype=bool)
        exact = np.empty(len(query))
        cuts = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True])
        for begin, end in zip(cuts[:-1], cuts[1:]):
            n, d = query[begin], doc[begin:end]
            low, asked, where, _, owner = self.batches[n // BATCH]
            words = asked[where[np.searchsorted(owner, n - low):np.searchsorted(owner, n - low, side="right")]]
            asks[words] = True
            run = held[d + 1] - held[d]
            spot = _flat(held[d], run)
            exact[begin:end] = np.bincount(np.repeat(np.arange(end - begin), run), weights=value[spot] * asks[at[spot]], minlength=end - begin)
            asks[words] = False
        own = query[cuts[:-1]]
        owners = np.r_[np.repeat(own, self.k), query]
        all_ids, scores = np.r_[self.best_id[own].ravel(), ids[doc]], np.r_[self.best[own].ravel(), exact]
        order = np.lexsort((all_ids, -scores, owners))
        kept = order[np.searchsorted(owners[order], own)[:, None] + np.arange(self.k)]
        self.best_id[own], self.best[own] = all_ids[kept], scores[kept]

    def found(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.best > 0)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.best_id[q, j]), pa.array(self.best[q, j])], ["query_id", "doc_id", "score"])


def _search(total: int, mean: float, k: int):
    """Rows of a cell: its queries, then its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, held, ids, sizes, terms, extra = None, None, 0, [], [], [], []

        def tile() -> None:
            lengths = np.array([len(t) // 8 for t in terms], dtype=np.int64)
            asked.add(np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.float64), np.frombuffer(b"".join(terms), dtype=np.int64), np.frombuffer(b"".join(extra), dtype=np.int32), lengths)

        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            for c, text, i, size, t, x in zip(*(batch.column(c).to_pylist() for c in ("cell", "row", "id", "size", "terms", "extra"))):
                if c != cell:
                    if asked and ids:
                        tile()
                    if asked:
                        yield asked.found()
                    cell, asked, held, ids, sizes, terms, extra = c, None, 0, [], [], [], []
                if text and asked is None:
                    if not ids:
                        continue  # no query in this cell
                    asked = Asked(np.array(ids, dtype=np.int64), [np.frombuffer(t, dtype=np.int64) for t in terms], [np.frombuffer(x, dtype=np.int32) for x in extra], total, mean, k)
                    held, ids, sizes, terms, extra = 0, [], [], [], []
                if text and (len(ids) == TILE or held + len(t) > TILE_WORDS * 8) and ids:
                    tile()
                    held, ids, sizes, terms, extra = 0, [], [], [], []
                held += len(t)
                ids.append(i), sizes.append(size), terms.append(t), extra.append(x)
        if asked and ids:
            tile()
        if asked:
            yield asked.found()
    return run


def top_k(docs: DataFrame, queries: Column, id_col: str = "doc_id", text_col: str = "text", k: int = TOP, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row where `queries` holds, the k best other rows by BM25 of their whole texts.

    Words are runs of word characters in lower case; each distinct word of the query counts once. Equal scores rank by id. Rows
    with the query's own id are never its hits, nor are rows that share no word. Null and empty texts find nothing and
    are never found; rows with a null id take no part. Rows that repeat an id are hits of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id IS NOT NULL")
    bags = stored(rows.select("id", "text").mapInArrow(_bags, "id long, size long, terms binary, counts binary"), "bm25-bags")
    counts = stored(bags.select("size", "terms").mapInArrow(_frequencies, "term long, n long, words long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("words").alias("words")), "bm25-terms")
    told = counts.where("term IS NULL").first()
    total, words = (told["n"], told["words"]) if told else (0, 0)
    shards = max(1, -(-total // shard_docs))
    shards = min(shards, max(SHARDS, -(-shards // GROWN)))
    asked = bags.join(rows.where("asks").select(F.col("id").alias("asker")).distinct(), F.col("id") == F.col("asker"), "left_semi").select("id", "terms")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, terms in zip(batch.column("id").to_pylist(), batch.column("terms").to_pylist()):
                found = np.frombuffer(terms, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i)), pa.array(found)], ["id", "term"])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        terms, often = table["term"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(terms)
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "terms": pa.array([terms[order].tobytes()], pa.binary()), "extra": pa.array([often[order].astype(np.int32).tobytes()], pa.binary())})

    known = asked.select("id", "terms").dropDuplicates(["id", "terms"]).mapInArrow(spread, "id long, term long").distinct().join(
        counts.where("term IS NOT NULL"), "term").select("id", "term", "n")
    ready = stored(known.groupBy("id").applyInArrow(gather, "id long, terms binary, extra binary"), "bm25-asked")
    held = ready.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    groups = max(1, -(-held // (8 * ASKED_WORDS)))

    def cell(shard: Column, group: Column) -> Column:
        return (shard * groups + group).cast("int").alias("cell")

    shard, group = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)), F.pmod(F.xxhash64("id", F.lit(12)), F.lit(groups))
    dealt = bags.select("id", "size", "terms", F.col("counts").alias("extra"), shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).select(
        cell(F.col("shard"), F.col("group")), F.lit(1).alias("row"), "id", "size", "terms", "extra")
    copies = ready.select("id", "terms", "extra", group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).select(
        cell(F.col("shard"), F.col("group")), F.lit(0).alias("row"), "id", F.lit(0).cast("long").alias("size"), "terms", "extra")
    hits = dealt.unionByName(copies).repartition("cell").sortWithinPartitions("cell", "row").mapInArrow(
        _search(total, words / max(1, total), k), "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
