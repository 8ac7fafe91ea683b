"""Sharding along a Hilbert curve: several metadata are quantised, rows follow the curve, and equal runs of it are the shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.llm.common import stored

BITS, SHARDS, GROUP_ROWS = 5, 16, 1 << 12


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the curve of points with integer coordinates under 2**bits, one row a point.

    Each level of the curve reflects or swaps what lies below it; undoing this from the top bit down leaves a Gray code.
    """
    x = axes.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            up = (x[i] >> level) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> level) & 1)
    return index


def text_dimensions(text: Column, bits: int = BITS) -> list[Column]:
    """Language and source by a hash of their names, and the size on a logarithmic scale, three steps to a factor of four."""
    cells = 1 << bits
    named = [F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(cells)) for c in ("lang", "source")]
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return [*named, F.least(F.floor(1.5 * F.log2(size + F.lit(1.0))), F.lit(cells - 1))]


def shard(
    docs: DataFrame, dimensions: list[Column], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shards: int = SHARDS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row.

    The law is `rows`: shards are runs of the curve whose counts are at most one apart. Rows of one cell of the curve follow
    a hash of the id, then the id (null first), then size and checksum; in this order a hot cell is ranked in many groups.
    Equal rows take neighbouring slots. A null text has size 1 and checksum 0. Null dimensions count as 0.
    """
    text = F.col(text_col).cast("string")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes = np.column_stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns[3:]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(curve_index(axes, bits))], ["doc_id", "size", "text_crc32", "curve"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), *[d.cast("long").alias(f"d{i}") for i, d in enumerate(dimensions)])
    narrow = stored(rows.mapInArrow(walk, "doc_id long, size long, text_crc32 long, curve long"), "hilbert")
    total = narrow.count()
    parts = max(1, -(-total // group_rows))
    keyed = narrow.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    counts = keyed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.groupBy("curve").agg(F.sum("n").alias("n")).select("curve", before(Window.orderBy("curve")).alias("cell_begin"))
    begins = counts.select("curve", "part", before(Window.partitionBy("curve").orderBy("part")).alias("part_begin")).join(cells, "curve").select(
        "curve", "part", (F.col("cell_begin") + F.col("part_begin")).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("curve", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    ranked = keyed.withColumn("inside", inside).join(begins, ["curve", "part"]).withColumn("rank", F.col("begin") + F.col("inside"))
    placed = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(1, total)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
