"""Near-duplicate vectors by NN-descent: a neighbour graph that neighbours of neighbours refine, round by round.

Equal vectors of a label are one node. The first graph comes from blocks of nodes on the same side of random hyperplanes. In a
round every node introduces its neighbours, those that list it included, to each other (the local join), and each keeps its
best, however far. A pair is met again only if one of the two is new to the list, and passed on only if it is better than what one
of them has. A node whose whole list passes the threshold is saturated, and its list doubles. Trees are as many as let a pair at
the threshold share a block with the wanted recall, whatever the number of planes. Vectors travel in single precision here; what
comes out as a link is checked in double precision.

Where a list is still saturated at the largest size, the node is in a crowd and introduces no more. All nodes of the label meet its crowds (the
components that hold such a node), and the links with them are counted without listing them: by angles to the crowd's centre where
these alone decide, and block by block where they don't. What links with a crowd joins its component. The recall of the counts is
audited against brute force for a sample that grows until it has met enough links; while it is too low, more hyperplanes and rounds
follow, and if it stays under `LEAST` there is an error instead of a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.llm.common import stored
from placeproof.llm.components import components

THRESHOLD, LIST, LARGEST, TREES, BLOCK, GROUP, ROUNDS, RECALL, LEAST = 0.93, 12, 24, 6, 512, 96, 8, 0.95, 0.9
CENTRES, SLACK = 4096, 1e-5
# The audit asks SAMPLE nodes, then four times as many, until ENOUGH nodes outside crowds had links or MOST nodes were asked.
SAMPLE, ENOUGH, MOST = 1024, 100, 16384


def nodes_of(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(label, vec, id, copies): distinct usable unit vectors under the least id that has them."""
    vec = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec")).where(
        F.coalesce(usable, F.lit(False)) & F.col("id").isNotNull()).withColumn("norm", norm).where("norm > 0 AND norm < double('infinity')").select(
        "id", "label", "vec", F.transform("vec", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def trees_for(bits: int, threshold: float) -> int:
    """How many trees let two vectors at the threshold share a block of `bits` hyperplanes with a probability of `RECALL`."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return TREES if meet >= RECALL else max(TREES, math.ceil(math.log(1 - RECALL) / math.log1p(-meet)))


def _first_lists(dims: int, bits: int, trees: range, blocks: int):
    """Which block a node falls into, for each tree: the sides of random hyperplanes, and a ticket that splits crowded blocks."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {t: np.random.default_rng(1000 + t).normal(size=(dims, bits)) for t in trees}
        for batch in batches:
            unit = _matrix(batch.column("unit"))
            for t in trees:
                side = ((unit @ planes[t]) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(unit), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("unit"), pa.array(np.full(len(unit), t, dtype=np.int32)), pa.array(side)], ["id", "label", "unit", "tree", "side"])
    return deal


def _best_in_block(keep: int):
    def best(key: tuple, table: pa.Table) -> pa.Table:
        ids, unit = table["id"].to_numpy(), _matrix(table["unit"])
        near = (unit @ unit.T).astype(np.float64)
        near[ids[:, None] == ids] = -2
        k = min(keep, len(ids) - 1)
        if k <= 0:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        to = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(near, to, axis=1).ravel()
        u, v, good = np.repeat(ids, k), ids[to.ravel()], sim > -2
        return pa.table({"u": u[good], "v": v[good], "sim": sim[good]})
    return best


def _introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The local join: pairs among the neighbours that one node introduces to each other, for each end that has no better list."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    host, part, ids, unit = table["host"].to_numpy(), table["part"].to_numpy(), table["id"].to_numpy(), _matrix(table["unit"])
    new, bound = table["new"].to_numpy(), table["bound"].to_numpy()
    order = np.lexsort((ids, part, host))
    cut = np.flatnonzero(np.r_[True, (host[order][1:] != host[order][:-1]) | (part[order][1:] != part[order][:-1])])
    us, vs, sims, size = [], [], [], 0
    for rows in np.split(order, cut[1:]):
        if len(rows) < 2:
            continue
        near = (unit[rows] @ unit[rows].T).astype(np.float64)
        i, j = np.nonzero((near > bound[rows][:, None]) & (new[rows][:, None] | new[rows]) & (ids[rows][:, None] != ids[rows]))
        us.append(ids[rows[i]]), vs.append(ids[rows[j]]), sims.append(near[i, j])
        size += len(i)
        if size > 1 << 18:
            yield _distinct(us, vs, sims)
            us, vs, sims, size = [], [], [], 0
    if size:
        yield _distinct(us, vs, sims)


def _distinct(us: list, vs: list, sims: list) -> pa.RecordBatch:
    u, v, sim = np.concatenate(us), np.concatenate(vs), np.concatenate(sims)
    order = np.lexsort((v, u))
    u, v, sim = u[order], v[order], sim[order]
    first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
    return pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(v[first]), pa.array(sim[first])], ["u", "v", "sim"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _shorten(edges: DataFrame, room: DataFrame | None, size: int) -> DataFrame:
    """The best of every node, as many as its list holds."""
    ranked = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    if room is not None:
        ranked = ranked.join(room, "u", "left")
    limit = F.coalesce(F.col("room"), F.lit(size)) if room is not None else F.lit(size)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("rank") <= limit).select("u", "v", "sim", "rank")


def _refined(nodes: DataFrame, start: DataFrame, threshold: float, rounds: int) -> DataFrame:
    graph = stored(_shorten(start, None, LIST).withColumn("new", F.lit(True)), "nn-graph")
    for turn in range(rounds):
        full = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("least"))
        saturated = (F.col("least") >= threshold) & (F.col("n") >= LIST)
        room = full.select("u", "n", "least", F.when(saturated, F.least(F.lit(LARGEST), 2 * F.col("n"))).otherwise(F.greatest("n", F.lit(LIST))).cast("int").alias("room"))
        bound = room.select(F.col("u").alias("id"), F.when(F.col("n") >= F.col("room"), F.col("least")).when(saturated, F.lit(threshold - SLACK)).otherwise(F.lit(-2.0)).alias("bound"))
        crowded = full.where((F.col("n") >= LARGEST) & (F.col("least") >= threshold)).select(F.col("u").alias("host"))
        ways = graph.select(F.col("u").alias("host"), F.col("v").alias("id"), "new").unionByName(graph.select(F.col("v").alias("host"), F.col("u").alias("id"), "new"))
        guests = ways.unionByName(full.select(F.col("u").alias("host"), F.col("u").alias("id"), F.lit(False).alias("new"))).groupBy("host", "id").agg(
            F.max("new").alias("new")).join(crowded, "host", "left_anti")
        # Hosts with more guests than a group holds deal them anew in each round, so all their pairs count as new.
        sizes = guests.groupBy("host").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"), F.max("new").alias("some")).where("some OR parts > 1")
        seated = guests.join(sizes, "host").select("host", "id", (F.col("new") | (F.col("parts") > 1)).alias("new"), F.pmod(F.xxhash64("host", "id", F.lit(turn)), F.col("parts")).cast("int").alias("part"))
        narrow = nodes.select("id", F.col("unit").cast("array<float>").alias("unit")).join(bound, "id", "left").select("id", "unit", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
        met = seated.join(narrow, "id").select("host", "part", "id", "unit", "new", "bound").repartition("host", "part").mapInArrow(_introduce, "u long, v long, sim double")
        old = graph.select("u", "v", F.lit(False).alias("new"))
        after = _shorten(graph.select("u", "v", "sim").unionByName(met), room.select("u", "room"), LIST)
        graph = stored(after.join(old, ["u", "v"], "left").withColumn("new", F.coalesce("new", F.lit(True))), "nn-graph")
        if graph.where("new").isEmpty():
            break
    return graph


def _checked(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v), both ways: the links among the pairs of a graph in single precision."""
    pairs = graph.where(F.col("sim") >= threshold - SLACK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    cos = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ends = pairs.join(nodes.select(F.col("id").alias("u"), "label", F.col("unit").alias("a")), "u").join(nodes.select(F.col("id").alias("v"), "label", F.col("unit").alias("b")), ["v", "label"])
    return _both_ways(ends.where(cos >= threshold).select("u", "v").distinct())


def _parts(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("int")


def _meet_centres(limit: float):
    """Which crowds a node may link with: by its angle to the centre and the crowd's widest angle; sure if it links with all."""
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        is_ball, ids, unit, widest = table["ball"].to_numpy(), table["id"].to_numpy(), _matrix(table["unit"]), table["widest"].to_numpy()
        angle = np.arccos(np.clip(unit[~is_ball] @ unit[is_ball].T, -1, 1))
        x, k = np.nonzero(angle <= limit + widest[is_ball] + 1e-6)
        return pa.table({"label": pa.array([key[0].as_py()] * len(x), pa.string()), "class": ids[is_ball][k], "id": ids[~is_ball][x], "sure": angle[x, k] + widest[is_ball][k] < limit - 1e-6})
    return meet


def _count_in_blocks(threshold: float):
    """Links between a block that asks and a block of a crowd; askers from outside any crowd count for the members too."""
    def count(key: tuple, table: pa.Table) -> pa.Table:
        asks, ids, unit = table["asks"].to_numpy(), table["id"].to_numpy(), _matrix(table["unit"])
        copies, outside = table["copies"].to_numpy(), table["outside"].to_numpy()
        near = (unit[asks] @ unit[~asks].T >= threshold) & (ids[asks][:, None] != ids[~asks])
        here, there = near @ copies[~asks], (copies[asks] * outside[asks]) @ near
        some, met = here > 0, there > 0
        return pa.table({"class": np.full(some.sum() + met.sum(), key[1].as_py()), "id": np.r_[ids[asks][some], ids[~asks][met]],
                         "others": np.r_[here[some], there[met]].astype(np.int64), "asks": np.r_[np.ones(some.sum(), bool), np.zeros(met.sum(), bool)]})
    return count


def _crowd_counts(nodes: DataFrame, crowds: DataFrame, threshold: float, dims: int) -> tuple[DataFrame, DataFrame]:
    """Every link that has an end in a crowd, counted exactly: (id, others), and which crowds a node links with: (id, class).

    All nodes of a label meet its crowds; crowds: (class, node).
    """
    limit = math.acos(threshold)
    told = nodes.select("label", "id", "unit", "copies").join(crowds.select(F.col("node").alias("id"), F.col("class").alias("home")), "id", "left")
    told = stored(told.withColumn("outside", F.col("home").isNull()), "nn-crowd")
    members = told.where("NOT outside").withColumn("class", F.col("home"))
    centre = members.groupBy("label", "class").agg(F.count("*").alias("size"), F.sum("copies").alias("all"), F.array(*[F.avg(F.col("unit")[i]) for i in range(dims)]).alias("mean"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    centre = centre.withColumn("norm", norm).withColumn("mean", F.when(F.col("norm") > 1e-9, F.transform("mean", lambda x: x / F.col("norm"))).otherwise(F.col("mean")))
    reach = F.when(F.col("norm") > 1e-9, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("unit"), F.col("mean")))))).otherwise(F.lit(math.pi))
    widest = members.join(centre, ["label", "class"]).groupBy("label", "class").agg(F.max(reach).alias("widest"))
    balls = stored(centre.join(widest, ["label", "class"]).select("label", "class", "size", "all", "mean", "widest"), "nn-balls")
    seat = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    grid = balls.groupBy("label").agg(_parts(F.count("*"), CENTRES).alias("n_balls")).join(nodes.groupBy("label").agg(_parts(F.count("*"), CENTRES).alias("n_nodes")), "label")
    coming = told.join(grid, "label").select("label", seat("id", "n_nodes").alias("i"), every("n_balls").alias("j"), F.lit(False).alias("ball"), "id", "unit", F.lit(0.0).alias("widest"))
    waiting = balls.join(grid, "label").select("label", every("n_nodes").alias("i"), seat("class", "n_balls").alias("j"), F.lit(True).alias("ball"), F.col("class").alias("id"), F.col("mean").alias("unit"), "widest")
    met = coming.unionByName(waiting).groupBy("label", "i", "j").applyInArrow(_meet_centres(limit), "label string, class long, id long, sure boolean")
    met = stored(met.join(told.select("label", "id", "copies", "home", "outside"), ["label", "id"]), "nn-met")

    sure = met.where("sure").join(balls.select("label", "class", "all"), ["label", "class"])
    counts = [sure.select("id", (F.col("all") - F.when(F.col("home") == F.col("class"), F.col("copies")).otherwise(0)).alias("others"))]
    guests = sure.where("outside").groupBy("label", "class").agg(F.sum("copies").alias("others"))
    counts.append(members.join(guests, ["label", "class"]).select("id", "others"))

    asking = met.where("NOT sure").groupBy("label", "class").agg(_parts(F.count("*"), BLOCK).alias("n_i"))
    sides = asking.join(balls.select("label", "class", _parts(F.col("size"), BLOCK).alias("n_j")), ["label", "class"])
    columns = ["label", "class", "i", "j", "asks", "id", "unit", "copies", "outside"]
    asks = met.where("NOT sure").join(sides, ["label", "class"]).join(told.select("label", "id", "unit"), ["label", "id"]).select(
        "label", "class", seat("id", "n_i").alias("i"), every("n_j").alias("j"), F.lit(True).alias("asks"), "id", "unit", "copies", "outside")
    asked = members.join(sides, ["label", "class"]).select("label", "class", every("n_i").alias("i"), seat("id", "n_j").alias("j"), F.lit(False).alias("asks"), "id", "unit", "copies", "outside")
    counted = stored(asks.select(columns).unionByName(asked.select(columns)).groupBy("label", "class", "i", "j").applyInArrow(
        _count_in_blocks(threshold), "class long, id long, others long, asks boolean"), "nn-counted")
    counts.append(counted.select("id", "others"))
    total = counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("id").agg(F.sum("others").alias("others"))
    return total, sure.select("id", "class").unionByName(counted.where("asks").select("id", "class")).distinct()


def _merged(classes: DataFrame, crowd_links: DataFrame) -> DataFrame:
    """(node, component) after the classes of nodes that link with a crowd have joined it."""
    own = crowd_links.join(classes, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("from"), "class")
    joined = components(own.where(F.col("from") != F.col("class")).select("from", "class").distinct(), "from", "class").select(F.col("node").alias("old"), F.col("component").alias("new"))
    all_nodes = classes.select("node", "component").unionByName(own.select(F.col("id").alias("node"), F.col("from").alias("component"))).distinct()
    return all_nodes.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))


def _true_counts(asked, threshold: float):
    """(id, true): part of the brute-force counts of the asked nodes; asked: label to (ids, units), broadcast."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ids, unit = np.array(batch.column("label").to_pylist()), batch.column("id").to_numpy(), _matrix(batch.column("unit"))
            copies = batch.column("copies").to_numpy()
            for label, (q, q_unit) in asked.value.items():
                here = np.flatnonzero(labels == label)
                true = np.zeros(len(q), dtype=np.int64)
                for at in range(0, len(here), BLOCK):
                    rows = here[at:at + BLOCK]
                    true += copies[rows] @ ((unit[rows] @ q_unit.T >= threshold) & (ids[rows][:, None] != q))
                yield pa.RecordBatch.from_arrays([pa.array(q[true > 0]), pa.array(true[true > 0])], ["id", "true"])
    return count


def _recall(nodes: DataFrame, counts: DataFrame, crowds: DataFrame, threshold: float) -> float:
    """Counted by true links of sampled nodes, by brute force over all nodes: the lower of those in crowds and the others."""
    context, sample, total = nodes.sparkSession.sparkContext, SAMPLE, nodes.count()
    while True:
        picked = nodes.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).select("id", "label", "unit").toArrow()
        labels, ids, unit = np.array(picked["label"].to_pylist()), picked["id"].to_numpy(), _matrix(picked["unit"])
        asked = context.broadcast({label: (ids[labels == label], unit[labels == label]) for label in np.unique(labels)})
        true = nodes.select("label", "id", "unit", "copies").mapInArrow(_true_counts(asked, threshold), "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
        rows = true.join(counts, "id", "left").join(crowds.select(F.col("node").alias("id"), F.lit(True).alias("crowd")), "id", "left").groupBy("crowd").agg(
            F.count("*").alias("n"), F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("others", F.lit(0)))).alias("found")).collect()
        if sample >= min(total, MOST) or sum(r.n for r in rows if not r.crowd) >= ENOUGH:
            return min((r.found / r.true for r in rows), default=1.0)
        sample *= 4


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    trees: int | None = None, rounds: int = ROUNDS, tries: int = 3,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows with an unusable vector (null, zero, null or non-finite components) or a null label or id have no links and are their own
    component. Rows that share an id are one vector each but one node of the result's components. Vectors of one label must
    have one length. An empty table gives an empty result. `trees` is by default as many as `trees_for` says. A RuntimeError
    says that the audited recall stayed under `LEAST` after all tries.
    """
    usable = nodes_of(rows, id_col, vector_col, label_col)
    named = stored(usable, "nn-vectors")
    keyed = named.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    nodes = stored(keyed, "nn-nodes")
    first = nodes.select(F.size("unit")).first()
    everyone = rows.select(F.col(id_col).cast("long").alias("vec_id"))
    if first is None:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims = first[0]
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0]
    bits = max(0, min(40, math.ceil(math.log2(max(1, largest / (BLOCK / 4))))))
    trees = trees or trees_for(bits, threshold)
    weight = nodes.select(F.col("id").alias("v"), "copies")
    start = None
    for attempt in range(tries):
        dealt = nodes.select("id", "label", F.col("unit").cast("array<float>").alias("unit")).mapInArrow(
            _first_lists(dims, bits, range(attempt * trees, (attempt + 1) * trees), BLOCK), "id long, label string, unit array<float>, tree int, side long")
        crowds = dealt.groupBy("tree", "label", "side").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        seated = dealt.join(crowds, ["tree", "label", "side"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))
        found = seated.groupBy("tree", "label", "side", "part").applyInArrow(_best_in_block(LIST), "u long, v long, sim double")
        start = found if start is None else start.unionByName(found)
        graph = _refined(nodes, start, threshold, rounds)
        links = stored(_checked(graph, nodes, threshold), "nn-links")
        crowded = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("least")).where((F.col("n") >= LARGEST) & (F.col("least") >= threshold)).select("u")
        classes = stored(components(links, "u", "v"), "nn-classes")
        crowds = stored(classes.join(classes.join(crowded, F.col("node") == F.col("u")).select("component").distinct(), "component").select(F.col("component").alias("class"), "node"), "nn-crowds")
        plain = links.join(crowds, F.col("u") == F.col("node"), "left_anti").join(weight, "v").groupBy(F.col("u").alias("id")).agg(F.sum("copies").alias("others"))
        exact, crowd_links = _crowd_counts(nodes, crowds, threshold, dims)
        counted = stored(plain.unionByName(exact).groupBy("id").agg(F.sum("others").alias("others")), "nn-counts")
        recall = _recall(nodes, counted, crowds, threshold)
        if recall >= RECALL:
            break
        start = graph.select("u", "v", "sim")
    if recall < LEAST:
        raise RuntimeError(f"audited recall {recall:.3f} after {tries} tries; raise trees or rounds")
    classes = stored(_merged(classes, crowd_links), "nn-classes")
    result = nodes.join(counted, "id", "left").join(classes, F.col("id") == F.col("node"), "left").select(
        "label", "vec", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = named.select("id", "label", "vec").join(result, ["label", "vec"]).select("id", "n_links", "component_id")
    linked = linked.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return everyone.join(linked, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
