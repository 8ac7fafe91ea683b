"""Centroid clustering of integer vectors: an n-simplex projection filters centroids, integers decide.

The pivots are base points of a simplex. A vector's distances to them, worked out once and stored, place it as the apex over
that base: coordinates inside the pivots' space and an altitude above it. For two apexes the distance with altitudes on one side
is a lower bound of the real distance, the one with altitudes on opposite sides an upper bound. A centroid whose lower bound is
above the least upper bound can't be nearest; the others are compared by exact integer distances.

The first round's pivots are the starts themselves. Those of all later rounds are the centroids after the first round: centroids
stay near that base, so their altitudes are small and the two bounds close to each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.llm.common import stored

CLUSTERS, DIMS, SCALE, ROUNDS, SEED = 16, 64, 64, 3, "1"
FLAT = 0.02
"""A start becomes a pivot only if it stands above the pivots before it by this part of the widest distance."""
SLACK = 1e-6
"""Of the squared distances to the first pivot: far above the rounding of the projection, whose base is never flat."""
NARROW = 1 << 27
"""Components up to this size are compared as 64-bit integers: 64 * (2 ** 28) ** 2 fits. Others as Python integers."""
LIMB = 32
LONG = (1 << 63) - 1


def integers(x: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x) for every component, exact for any finite double."""
    return [int(np.floor(scale * c)) if abs(c) < 2.0**40 else int(c) * scale for c in x]


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


@dataclass(frozen=True)
class Base:
    """The pivots and the triangular map from distances to coordinates. Without pivots (no narrow point) there are no bounds."""

    pivots: np.ndarray
    gram: np.ndarray
    solve: np.ndarray

    @classmethod
    def of(cls, points: list[list[int]]) -> Base:
        """Pivots from the points, the one that stands highest above those chosen first, until the rest lie flat."""
        narrow = [p for p in points if max(map(abs, p)) <= NARROW]
        if not narrow:
            return cls(np.zeros((0, 0), np.int64), np.zeros(0), np.zeros((0, 0)))
        all_points = np.array(narrow, dtype=np.int64)
        shifted = (all_points - all_points[0]).astype(np.float64)
        rest, chosen = shifted.copy(), [0]
        widest = float((shifted**2).sum(axis=1).max())
        while True:
            height = (rest**2).sum(axis=1)
            best = int(height.argmax())
            if height[best] <= FLAT**2 * widest or height[best] == 0:
                break
            chosen.append(best)
            axis = rest[best] / np.sqrt(height[best])
            rest = rest - np.outer(rest @ axis, axis)
        sides = shifted[chosen[1:]]
        gram = sides @ sides.T
        solve = np.linalg.inv(np.linalg.cholesky(gram)).T if len(sides) else np.zeros((0, 0))
        return cls(all_points[chosen], np.diag(gram).copy(), solve)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Exact squared distances of narrow vectors to every pivot."""
        out = np.empty((len(vectors), len(self.pivots)), dtype=np.int64)
        for i, pivot in enumerate(self.pivots):
            out[:, i] = ((vectors - pivot) ** 2).sum(axis=1)
        return out

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates over the base, then the altitude, then the squared distance to the first pivot."""
        if not len(self.pivots):
            return np.zeros((len(vectors), 0))
        far = self.distances(vectors).astype(np.float64)
        inside = (far[:, :1] + self.gram - far[:, 1:]) / 2 @ self.solve
        altitude = np.sqrt(np.maximum(0, far[:, 0] - (inside**2).sum(axis=1)))
        return np.column_stack([inside, altitude, far[:, 0]])


def possible(apexes: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For every vector and centroid, whether the bounds let the centroid be the nearest one."""
    if not apexes.shape[1]:
        return np.ones((len(apexes), len(centers)), dtype=bool)
    inside = ((apexes[:, None, :-2] - centers[None, :, :-2]) ** 2).sum(axis=2)
    lower = inside + (apexes[:, None, -2] - centers[None, :, -2]) ** 2
    upper = inside + (apexes[:, None, -2] + centers[None, :, -2]) ** 2
    slack = SLACK * (1 + apexes[:, -1] + centers[:, -1].max())
    return lower <= (upper.min(axis=1) + slack)[:, None]


class Nearest:
    """Exact nearest centroid, the smaller number on ties, of vectors with or without an apex."""

    def __init__(self, base: Base, centers: list[list[int]]):
        self.centers = centers
        self.narrow = [j for j, c in enumerate(centers) if max(map(abs, c)) <= NARROW]
        self.wide = [j for j in range(len(centers)) if j not in set(self.narrow)]
        self.numbers = np.array([centers[j] for j in self.narrow], dtype=np.int64).reshape(len(self.narrow), DIMS)
        self.apexes = base.apexes(self.numbers)

    def of_narrow(self, vectors: np.ndarray, apexes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        if self.narrow:
            rows, at = np.nonzero(possible(apexes, self.apexes))
            far = np.concatenate([
                ((vectors[rows[i:i + 65536]] - self.numbers[at[i:i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(rows), 65536)])
            begins = np.searchsorted(rows, np.arange(len(vectors)))
            least = np.minimum.reduceat(far, begins)
            hits = np.flatnonzero(far == least[rows])
            first = hits[np.searchsorted(rows[hits], np.arange(len(vectors)))]
            cluster, distance = np.array(self.narrow)[at[first]], least.tolist()
        else:
            cluster, distance = np.full(len(vectors), -1), [None] * len(vectors)
        for j in self.wide:
            center = self.centers[j]
            axis = int(np.argmax([abs(c) for c in center]))
            gap = float(min(abs(center[axis]), 10**150)) - np.abs(vectors[:, axis]).astype(np.float64)
            known = np.array([np.inf if d is None else d for d in distance], dtype=np.float64)
            for i in np.flatnonzero(gap**2 * (1 - 1e-9) <= known):
                far_one = squared(vectors[i].tolist(), center)
                if distance[i] is None or (far_one, j) < (distance[i], int(cluster[i])):
                    cluster[i], distance[i] = j, far_one
        return cluster, distance

    def of_wide(self, vector: list[int]) -> tuple[int, int]:
        far, j = min((squared(vector, c), j) for j, c in enumerate(self.centers))
        return j, far


def usable(vectors: Column, dims: int = DIMS) -> Column:
    """Vectors with the right number of components, none of them null or not finite."""
    return (F.size(vectors) == dims) & F.forall(vectors, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), kind))


def _projected(rows: DataFrame, base: Base) -> DataFrame:
    """(id, v, apex) of narrow vectors, (id, x) of wide ones: what every round reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), np.float64).reshape(len(batch), DIMS)
            narrow = np.abs(x).max(axis=1, initial=0) <= NARROW / SCALE
            for rows_of, is_narrow in ((np.flatnonzero(narrow), True), (np.flatnonzero(~narrow), False)):
                if not len(rows_of):
                    continue
                ids, n = batch.column(0).take(pa.array(rows_of)), len(rows_of)
                no_ints, no_reals = pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.float64()))
                if is_narrow:
                    v = np.floor(x[rows_of] * SCALE).astype(np.int64)
                    columns = [ids, _lists(v, pa.int32()), _lists(base.apexes(v), pa.float64()), no_reals]
                else:
                    columns = [ids, no_ints, no_reals, _lists(x[rows_of], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "apex", "x"])
    return rows.mapInArrow(run, "id long, v array<int>, apex array<double>, x array<double>")


def _assigned(batch: pa.RecordBatch, nearest: Nearest) -> Iterator[tuple[pa.Array, list | np.ndarray, np.ndarray, list[int]]]:
    """(ids, integer vectors, clusters, distances) of a stored batch, narrow vectors first."""
    narrow = np.asarray(batch.column("v").is_valid())
    at = np.flatnonzero(narrow)
    if len(at):
        part = batch.take(pa.array(at))
        vectors = _matrix(part.column("v"), np.int64).reshape(len(at), DIMS)
        apexes = _matrix(part.column("apex"), np.float64).reshape(len(at), -1)
        yield part.column("id"), vectors, *nearest.of_narrow(vectors, apexes)
    at = np.flatnonzero(~narrow)
    if len(at):
        part = batch.take(pa.array(at))
        vectors = [integers(x) for x in part.column("x").to_pylist()]
        found = [nearest.of_wide(v) for v in vectors]
        yield part.column("id"), vectors, np.array([j for j, _ in found]), [d for _, d in found]


def _limbs(value: int) -> list[int]:
    """Low digits base 2 ** LIMB, the last one with the sign: sums of digits give the sum of values."""
    out = []
    while not -NARROW <= value <= NARROW:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _moved(rows: DataFrame, base: Base, centers: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: every task sums its vectors by cluster, one small row a cluster goes on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(base, centers)
        counts: dict[int, int] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(cluster: int, limb: int, amount: np.ndarray) -> None:
            sums[cluster, limb] = sums.get((cluster, limb), 0) + amount
        for batch in batches:
            for _, vectors, clusters, _ in _assigned(batch, nearest):
                for j in np.unique(clusters).tolist():
                    members = np.flatnonzero(clusters == j)
                    counts[j] = counts.get(j, 0) + len(members)
                    if isinstance(vectors, np.ndarray):
                        add(j, 0, vectors[members].sum(axis=0))
                        continue
                    for i in members.tolist():
                        for axis, value in enumerate(vectors[i]):
                            for limb, digit in enumerate(_limbs(value)):
                                one = np.zeros(DIMS, dtype=np.int64)
                                one[axis] = digit
                                add(j, limb, one)
        keys = sorted(sums)
        amounts = np.array([sums[k] for k in keys], dtype=np.int64).reshape(len(keys), DIMS)
        each = [np.repeat(np.array(c, dtype=np.int64), DIMS) for c in ([j for j, _ in keys], [limb for _, limb in keys], [counts[j] * (limb == 0) for j, limb in keys])]
        yield pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(np.tile(np.arange(DIMS), len(keys))), pa.array(amounts.ravel())], ["cluster", "limb", "n", "axis", "amount"])
    partial = rows.mapInArrow(run, "cluster long, limb long, n long, axis long, amount long")
    total = partial.groupBy("cluster", "limb", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("amount").cast("decimal(20,0)")).alias("amount")).collect()
    counts, sums = {}, {}
    for r in total:
        counts[r["cluster"]] = max(counts.get(r["cluster"], 0), r["n"])
        sums[r["cluster"], r["axis"]] = sums.get((r["cluster"], r["axis"]), 0) + (int(r["amount"]) << (LIMB * r["limb"]))
    return [[sums[j, i] // counts[j] for i in range(DIMS)] if j in counts else c for j, c in enumerate(centers)]


def cluster(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept.

    Kept are vectors of 64 finite components; each row counts, also if ids or vectors repeat. The first centroids are the `k` kept vectors with
    the least SHA-256 of `seed:id` (rows without an id come last, ties by components); fewer vectors give fewer centroids, no
    vectors no rows. Components of any size are compared exactly; a distance or a sum that doesn't fit in a long is null.
    """
    spark = rows.sparkSession
    x = F.col(vec_col).cast("array<double>")
    kept = rows.where(usable(x)).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    starts = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not starts:
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    centers = [integers(r["x"]) for r in starts]
    base = Base.of(centers)
    if rounds:
        centers = _moved(_projected(kept, base), base, centers)
        base = Base.of(centers)
    cached = stored(_projected(kept, base), "simplex")
    for _ in range(rounds - 1):
        centers = _moved(cached, base, centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(base, centers)
        for batch in batches:
            for ids, _, clusters, distances in _assigned(batch, nearest):
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(clusters, pa.int32()), pa.array([d if d <= LONG else None for d in distances], pa.int64())], ["vec_id", "cluster", "distance"])
    found = stored(cached.mapInArrow(run, schema), "clusters")
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)"))).alias("s")).collect()
    whole = None if any(r["s"] is None for r in sums) else sum(int(r["s"]) for r in sums)

    def as_long(value: int | None) -> int | None:
        return int(value) if value is not None and value <= LONG else None
    facts = spark.createDataFrame(
        [(r["cluster"], as_long(r["s"]), as_long(whole), hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same rounds in SQL over the whole table `embeddings`, every vector against every centroid."""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, embedding, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {DIMS})""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, embedding) - 1 AS j, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v, embedding FROM kept ORDER BY h NULLS LAST, embedding LIMIT {k}))"]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rn, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), j := j)) AS best
  FROM kept, c{r} GROUP BY rn)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.j, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (
  SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT best.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN kept USING (rn), range(1, {DIMS + 1}) AS t(i) GROUP BY ALL) GROUP BY j) n ON o.j = n.j)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rn) JOIN c{rounds} ON best.j = c{rounds}.j"""
