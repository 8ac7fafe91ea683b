"""Connected components by alternating large and small stars, as joins and sums; no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
        edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    rest = edges.join(least, "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return rest.unionByName(least.select("v", F.col("m").alias("u"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link to another one.

    Links may repeat, point either way or join a node with itself; those with a null end are ignored. No links: no rows.
    """
    now = cut_lineage(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    seen = _signature(now)
    while seen[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        then, seen = seen, _signature(now)
        if then == seen:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
