"""Variable-capacity best-fit packing of token sequences into bins of several permitted lengths.

Pieces are dealt by a hash to groups of about equal, bounded size, and each group is packed by itself: longest piece first
into the open bin with least room that takes it. Where none does, the bin size is opened whose cost for each token is least,
looking ahead at what the remaining pieces would fill. At the end every bin shrinks to the least permitted length that holds it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.llm.common import stored

LENGTHS, OVERHEAD, GROUP_PIECES, LOOK_AHEAD = (512, 1024, 2048, 4096, 8192), 16, 1 << 12, 12


def words(text: Column) -> Column:
    """Tokens as runs of anything but white space."""
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


class _Left:
    """Pieces not yet packed, by length."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.lengths = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.lengths[bisect_left(self.lengths, size)]

    def fill(self, room: int) -> int:
        """How much of `room` the largest fitting pieces would take, one after another."""
        used, taken = 0, {}
        for _ in range(LOOK_AHEAD):
            i = bisect_right(self.lengths, room - used) - 1
            while i >= 0 and taken.get(self.lengths[i], 0) >= self.count[self.lengths[i]]:
                i -= 1
            if i < 0:
                break
            s = self.lengths[i]
            n = min(self.count[s] - taken.get(s, 0), (room - used) // s)
            taken[s] = taken.get(s, 0) + n
            used += n * s
        return used


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """For pieces in falling order of size, none over the largest length: bin of each, offset in it, and capacity of each bin."""
    left = _Left(sizes)
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    content: list[int] = []
    size_of: list[int] = []
    bins, offsets = [], []
    for s in sizes:
        left.take(s)
        i = bisect_left(rooms, s)
        if i < len(rooms):
            room = rooms[i]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[i]
        else:
            size = min((c for c in lengths if c >= s), key=lambda c: ((c + overhead) / (s + left.fill(c - s)), c))
            b, room = len(content), size
            content.append(0)
            size_of.append(size)
        bins.append(b)
        offsets.append(content[b])
        content[b] += s
        room -= s
        if room:
            if room not in by_room:
                insort(rooms, room)
            by_room.setdefault(room, []).append(b)
    return bins, offsets, [min(c for c in lengths if c >= n) for n in content]


def _pack_group(lengths: tuple[int, ...], overhead: int, key: tuple, table: pa.Table) -> pa.Table:
    doc, piece, size = (table[c].to_pylist() for c in ("doc_id", "piece", "n_tokens"))
    rows = sorted(range(len(size)), key=lambda i: (-size[i], doc[i] is None, doc[i] or 0, piece[i]))
    bins, offsets, capacity = best_fit([size[i] for i in rows], lengths, overhead)
    base = key[0].as_py() << 32
    out = table.take(pa.array(rows, pa.int64())).select(["doc_id", "piece", "begin", "n_tokens"])
    for name, values, kind in (("bin_id", [base + b for b in bins], pa.int64()), ("bin_offset", offsets, pa.int64()), ("bin_length", [capacity[b] for b in bins], pa.int64())):
        out = out.append_column(name, pa.array(values, kind))
    return out


def pack(
    docs: DataFrame, tokens: Column, id_col: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """(doc_id, piece, begin, n_tokens, bin_id, bin_offset, bin_length): every token of every row in exactly one bin.

    Rows longer than the largest length are cut into pieces of it and a rest. Rows without tokens give one piece without a
    bin (null id and offset, length 0). Repeated rows and null ids are packed like any others. Bins never cross groups, which are
    counted from pieces and dealt by row and piece, so that neither one long text nor one repeated id fills a group.
    """
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    counted = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(tokens, F.lit(0)).cast("long").alias("all"), F.monotonically_increasing_id().alias("row")), "packing")
    total = counted.agg(F.sum(F.expr(f"greatest(1, (all + {longest - 1}) div {longest})"))).first()[0] or 0
    pieces = counted.select("doc_id", "all", "row", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(all - 1) div {longest}").cast("int")))).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * longest).alias("begin"), F.least(F.lit(longest), F.col("all") - F.col("piece").cast("long") * longest).alias("n_tokens"), "row")
    groups = max(1, -(-total // group_pieces))
    number = F.pmod(F.xxhash64("row", "piece"), F.lit(groups))
    dealt = pieces.select("doc_id", "piece", "begin", "n_tokens", F.when(F.col("n_tokens") > 0, number).otherwise(F.lit(-1) - number).alias("group"))
    work = partial(_maybe_pack, lengths, overhead)
    return dealt.groupBy("group").applyInArrow(
        lambda key, table: work(key, table), "doc_id long, piece int, begin long, n_tokens long, bin_id long, bin_offset long, bin_length long")


def _maybe_pack(lengths: tuple[int, ...], overhead: int, key: tuple, table: pa.Table) -> pa.Table:
    if key[0].as_py() >= 0:
        return _pack_group(lengths, overhead, key, table)
    n = table.num_rows
    out = table.select(["doc_id", "piece", "begin", "n_tokens"])
    for name, values in (("bin_id", [None] * n), ("bin_offset", [None] * n), ("bin_length", [0] * n)):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out
