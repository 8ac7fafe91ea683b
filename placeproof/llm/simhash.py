"""SimHash near-dedup: fingerprints embedded as per-segment bit counts, joined on a grid, verified bit by bit.

Two fingerprints that differ in d bits have segment counts at Manhattan distance d or less. So every fingerprint meets, on
the grid of count vectors, all cells within the allowed distance of its own (one half of that ball: each pair of cells once),
and only fingerprints that meet are compared exactly. A crowded cell isn't compared pairwise: fingerprints within two bits
share a value when each is spread to itself and its one-bit neighbours, which takes linear work.

Two bits out of 64 are a similarity of about 0.99. For a lower one (`similar_texts`) a text has further fingerprints, each of a
few of its shingles, drawn by least hash under a seed of its own: texts of similarity s have the same draw of four with
probability s ** 4. Of what meets, pairs whose numbers of shingles or bitmaps of shingle hashes already exclude the similarity
are left out, which loses none; the rest is compared exactly, shingle by shingle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.llm.common import as_bytes, stored
from placeproof.llm.components import components

WORDS, SEED, SEGMENTS, BITS = 3, 42, 8, 64
CROWDED = 1024
LIKE_WORDS, LIKE, DRAWS, DRAWN = 5, 0.8, 8, 4
SALTS, ONE_LEAD_ROUNDS, LEADS_AT_ONCE = 8, 2, 128
PAIRS_AT_ONCE = 1 << 21
BITMAP_LONGS = 16


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; one for a text of fewer words, none without words."""
    parts = text.lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not parts:
        return np.zeros(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """64 bits: each is 1 where over half of the hashes have it; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. A null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def half_ball(segments: int, distance: int) -> np.ndarray:
    """Integer vectors of Manhattan length 1 to `distance`, one of each pair of opposites."""
    found = set()
    for places in itertools.combinations_with_replacement(range(segments), distance):
        for signs in itertools.product((-1, 0, 1), repeat=distance):
            v = [0] * segments
            for p, s in zip(places, signs):
                v[p] += s
            lead = next((x for x in v if x), 0)
            if lead > 0:
                found.add(tuple(v))
    return np.array(sorted(found), dtype=np.int64).reshape(-1, segments)


def spread_over_grid(fps: np.ndarray, segments: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, fingerprint, at home): its own cell and the reachable cells of half the ball around it."""
    width = BITS // segments
    counts = np.bitwise_count((fps[:, None] >> (np.arange(segments, dtype=np.uint64) * np.uint64(width))) & np.uint64(2**width - 1)).astype(np.int64)
    weights = (width + 1) ** np.arange(segments, dtype=np.int64)
    cells, owners = [counts @ weights], [np.arange(len(fps))]
    for step in half_ball(segments, distance):
        there = np.flatnonzero(((counts + step >= 0) & (counts + step <= width)).all(axis=1))
        cells.append(cells[0][there] + step @ weights)
        owners.append(there)
    home = np.zeros(sum(map(len, cells)), dtype=bool)
    home[: len(fps)] = True
    return np.concatenate(cells), fps[np.concatenate(owners)], home


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b, (value, least value of its component here): at most one link a value."""
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        after = after[after]
        while not np.array_equal(jumped := after[after], after):
            after = jumped
        if np.array_equal(after, label):
            break
        label = after
    own = np.flatnonzero(label != np.arange(len(values)))
    return values[own], values[label[own]]


def links_in_cells(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int, crowded: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within `distance` bits between what is at home in a cell and all that meets it there, as a forest."""
    order = np.lexsort((~home, cell))
    cell, fp, home = cell[order], fp[order], home[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, dtype=np.int64)
    ends = np.r_[starts[1:], len(cell)].astype(np.int64)
    homes = np.add.reduceat(home, starts, dtype=np.int64) if len(cell) else starts
    found: list[tuple[np.ndarray, np.ndarray]] = []
    full = homes > crowded if distance == 2 else np.zeros(len(homes), dtype=bool)
    for s, e in zip(starts[full], ends[full]):
        own = np.unique(fp[s:e])
        near = np.concatenate([own, *(own ^ np.uint64(1 << i) for i in range(BITS))])
        owner = np.tile(own, BITS + 1)
        by = np.argsort(near, kind="stable")
        near, owner = near[by], owner[by]
        same = np.flatnonzero(near[1:] == near[:-1])
        found.append(forest(owner[same], owner[same + 1]))
    until = np.repeat(np.where(full, starts, ends), ends - starts)
    at = np.flatnonzero(home)
    more = until[at] - at - 1
    at, more = at[more > 0], more[more > 0]
    total = np.cumsum(more)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS_AT_ONCE)))
        n = more[i:j]
        left = np.repeat(at[i:j], n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(fp[left] ^ fp[right]) <= distance
        found.append((fp[left[near]], fp[right[near]]))
        if len(found) > 64:
            found = [forest(*map(np.concatenate, zip(*found)))]
        i = j
    return forest(*map(np.concatenate, zip(*found))) if found else (fp[:0], fp[:0])


def near_links(fps: DataFrame, distance: int = 2, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that join exactly the distinct values of `fp` which chains of links within `distance` bits join."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(values), 2048):
                cell, fp, home = spread_over_grid(values[i:i + 2048], segments, distance)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp.view(np.int64)), pa.array(home)], ["cell", "fp", "home"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
        if parts:
            a, b = links_in_cells(*map(np.concatenate, zip(*parts)), distance, crowded)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    cells = fps.select("fp").mapInArrow(spread, "cell long, fp long, home boolean")
    return cells.repartition("cell").mapInArrow(meet, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = 2, segments: int = SEGMENTS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Null and empty texts, and those without words, have fingerprint zero and link like any other. Rows that share a
    doc_id are one document per fingerprint; a null doc_id gets the component of its fingerprint's other documents (null if none).
    An empty table gives an empty result; other columns are ignored.
    """
    if distance > 2 * segments or BITS % segments:
        raise ValueError("segments must divide 64")
    marks = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    groups = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-groups")
    linked = components(near_links(groups, distance, segments), "a", "b")
    classes = groups.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("class"))
    least = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "class").select("fp", "component_id")
    return marks.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drawn_fingerprints(hashes: np.ndarray, draws: int = DRAWS, drawn: int = DRAWN) -> list[int]:
    """One fingerprint a draw, from distinct hashes: of the `drawn` shingles with the least mixed hash, all if there are fewer."""
    out = []
    for i in range(draws):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & (2**64 - 1))
        few = hashes[np.argpartition(mixed ^ (mixed >> np.uint64(32)), drawn - 1)[:drawn]] if len(hashes) > drawn else hashes
        out.append(majority(few))
    return out


def _merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle: sides that grow with the input and are joined once a round don't pass through the driver as broadcasts."""
    return left.join(right.hint("merge"), on, how)


def _met(texts: DataFrame, words: int, draws: int, drawn: int, distance: int) -> DataFrame:
    """(class, node, size): texts with a common fingerprint of a draw, or with near fingerprints of the whole text, by class and its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, kinds, fps = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                hashes = shingle_hashes(text, words)
                if len(hashes):
                    found = [majority(hashes), *drawn_fingerprints(np.unique(hashes), draws, drawn)]
                    nodes += [node] * len(found)
                    kinds += range(len(found))
                    fps += found
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(kinds, pa.int32()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["node", "kind", "fp"])
    marks = stored(texts.select("node", "text").mapInArrow(run, "node string, kind int, fp long").distinct(), "similar-marks")
    whole = marks.where("kind = 0").select("fp").distinct()
    linked = components(near_links(whole, distance), "a", "b").select(F.col("node").alias("f"), F.col("component").alias("c"))
    named = _merged(marks.where("kind = 0"), linked, F.col("fp") == F.col("f"), "left").select("node", "kind", F.coalesce("c", "fp").alias("fp"))
    every = named.unionByName(marks.where("kind > 0"))
    shared = every.groupBy("kind", "fp").agg(F.count("*").alias("n")).where("n > 1").select(F.col("kind").alias("k"), F.col("fp").alias("f"), F.col("n").alias("size"))
    return stored(_merged(every, shared, (F.col("kind") == F.col("k")) & (F.col("fp") == F.col("f"))).select(F.struct("kind", "fp").alias("class"), "node", "size"), "similar-classes")


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, n, bits, hashes) of texts: how many different shingles, a bitmap of where their hashes fall, the sorted hashes themselves."""
    shift = np.uint64(64 - (64 * BITMAP_LONGS - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in as_bytes(batch.column(1))]
            marked = np.zeros((len(sets), 64 * BITMAP_LONGS), dtype=np.uint8)
            for i, hashes in enumerate(sets):
                marked[i, hashes >> shift] = 1
            bits = np.packbits(marked, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(h) for h in sets], pa.int32()),
                pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BITMAP_LONGS, pa.array(bits.reshape(-1))),
                pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "n", "bits", "hashes"])
    return texts.select("node", "text").mapInArrow(run, "node string, n int, bits array<long>, hashes binary")


def _may_be_alike(similarity: float) -> Column:
    """Can (n, bits) and (lead_n, lead_bits) be this similar? A bit that only one has is a shingle that the other lacks."""
    def room(count: str, one: str, other: str) -> Column:
        lacking = sum((F.bit_count(F.get(one, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(i))))) for i in range(BITMAP_LONGS)), F.lit(0))
        return F.col(count) - lacking >= least
    # Common shingles needed, a hair less so that rounding excludes nothing.
    least = (similarity / (1 + similarity) - 1e-9) * (F.col("n") + F.col("lead_n"))
    return (F.least("n", "lead_n") >= least) & room("n", "bits", "lead_bits") & room("lead_n", "lead_bits", "bits")


def _compared(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """(lead, node, alike) of pairs of texts, by all their shingles. A lead of many is dealt over several tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for one, other in zip(batch.column(2), batch.column(3)):
                known, mine = np.frombuffer(one.as_buffer(), dtype="<u8"), np.frombuffer(other.as_buffer(), dtype="<u8")
                both = len(np.intersect1d(known, mine, assume_unique=True))
                alike.append(both >= similarity * (len(known) + len(mine) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], ["lead", "node", "alike"])
    sets = bodies.select("node", "hashes")
    leads = _merged(pairs.select(F.col("lead").alias("node")).distinct(), sets, "node").select(
        F.col("node").alias("lead"), F.col("hashes").alias("one"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    others = _merged(pairs, sets, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return _merged(others, leads, ["lead", "salt"]).select("lead", "node", "one", F.col("hashes").alias("other")).mapInArrow(run, "lead string, node string, alike boolean")


def similar_links(texts: DataFrame, words: int = LIKE_WORDS, similarity: float = LIKE, draws: int = DRAWS, drawn: int = DRAWN, distance: int = 2) -> DataFrame:
    """(lead, node): links between different texts (node, text) whose shingle sets have at least this similarity.

    In each class of texts that met, the one that meets most texts over all its classes leads (the least of equals): it lies nearest to
    the middle of a crowd. It is held against all others, and what is like it has found its place. The first of the rest
    leads next, again against the whole class, until every text leads or is like a leader; after two rounds `LEADS_AT_ONCE` of the
    rest lead together. So work is leaders times members, never all pairs of a crowd of copies, and no text stays without a leader
    it is like, if there is one in its class. Only pairs that sizes and bitmaps allow leave the join of leaders and members.
    """
    met = _met(texts, words, draws, drawn, distance)
    wanted = texts.join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    bodies = stored(_shingle_sets(wanted, words), "similar-texts")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    meets = met.groupBy("node").agg(F.sum("size").alias("meets"))
    sized = _merged(bodies.select("node", "n", "bits"), meets, "node")
    members = stored(_merged(met.select("class", "node"), sized, "node").select("class", salt, "node", "n", "bits", "meets"), "similar-members")
    waiting, done, rounds = members, None, 0
    while not waiting.isEmpty():
        rounds += 1
        place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("meets"), "node"))
        leads = waiting.withColumn("place", place).where(F.col("place") <= (1 if rounds <= ONE_LEAD_ROUNDS else LEADS_AT_ONCE)).select(
            "class", F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("bits").alias("lead_bits"))
        everywhere = leads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pair = [F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node")]
        asked = stored(_merged(members, everywhere, ["class", "salt"]).where("node <> lead").where(_may_be_alike(similarity)).select(
            "class", F.col("node").alias("member"), *pair), "similar-asked")
        pairs = asked.select("lead", "node").distinct()
        fresh = pairs if done is None else _merged(pairs, done, ["lead", "node"], "left_anti")
        found = stored(_compared(fresh, bodies, similarity), "similar-compared")
        done = found if done is None else stored(done.unionByName(found), "similar-done")
        settled = _merged(asked, done.where("alike"), ["lead", "node"]).select("class", F.col("member").alias("node"))
        settled = settled.unionByName(leads.select("class", F.col("lead").alias("node"))).distinct()
        waiting = stored(_merged(waiting, settled, ["class", "node"], "left_anti"), "similar-waiting")
    return done.where("alike").select("lead", "node") if done is not None else bodies.select(F.col("node").alias("lead"), "node").limit(0)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs`, one of each group of similar texts: that with the smallest id, then the least text digest.

    Groups are texts linked by `similar_links`, in chains. Equal texts are one text, and so are null and empty; texts without words
    are only like themselves. Rows without an id stay only if their group has no other; of rows equal in id and text one
    stays. No rows give no rows, and other columns, also with clashing names, go through as they are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.left(F.sha2(text, 256), F.lit(32)).alias("node"))
    linked = components(similar_links(rows.select("node", "text"), **how), "lead", "node").select(F.col("node").alias("member"), "component")
    grouped = rows.drop("text").join(linked, F.col("node") == F.col("member"), "left").withColumn("group", F.coalesce("component", "node"))
    return grouped.groupBy("group").agg(F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))).alias("row")).select("row.*")
