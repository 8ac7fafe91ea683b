"""Ordered computations that survive a hot key.

A window over one key runs in one task, and one key may hold a third of all rows. Here every key is cut into blocks of
its order, work inside a block is a bounded window, and only one small row per block meets in the per-key window.
Block borders depend on the data alone, so a recomputed task gives the same answer. Each function reads its input twice
(block totals and rows), so pass stored rows: a written table or `cut_lineage`, not a long unfinished plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20


def _block(seq: str, block_rows: int) -> Column:
    return F.floor(F.col(seq) / F.lit(block_rows)).cast("bigint")


def ordered_position(
    df: DataFrame, keys: list[str], order: list[Column], seq: str, out: str, block_rows: int = BLOCK_ROWS,
    inner: list[Column] | None = None,
) -> DataFrame:
    """1-based position within `keys` by `order` (ascending, few distinct values), ties by `seq` (unique in the key).

    With `inner`, rows of equal `order` are already few and are sorted by `inner` instead of `seq`.
    """
    names = [f"_o{i}" for i in range(len(order))]
    block_no = F.lit(0).cast("bigint") if inner else _block(seq, block_rows)
    tagged = df.withColumns({**dict(zip(names, order)), "_blk": block_no})
    block = [*keys, *names, "_blk"]
    before = Window.partitionBy(*keys).orderBy(*names, "_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy(*block).agg(F.count("*").alias("_n")).select(
        *block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy(*(inner or [F.col(seq)])))
    return tagged.withColumn("_rn", inside).join(offsets, block).withColumn(
        out, (F.col("_off") + F.col("_rn")).cast("bigint")).drop(*names, "_blk", "_rn", "_off")


def running_before(
    df: DataFrame, keys: list[str], seq: str, values: dict[str, Column], how: str = "sum", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Sum, min or max of each value over the rows of the key with a smaller `seq`; null where there are none."""
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    names = {f"_v{i}": value for i, value in enumerate(values.values())}
    tagged = df.withColumns({**names, "_blk": _block(seq, block_rows)})
    block = [*keys, "_blk"]
    earlier_blocks = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tagged.groupBy(*block).agg(*[fold(n).alias(n + "b") for n in names]).select(
        *block, *[fold(n + "b").over(earlier_blocks).alias(n + "c") for n in names])
    earlier = Window.partitionBy(*block).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    scanned = tagged.withColumns({n + "i": fold(n).over(earlier) for n in names}).join(carry, block)
    for out, n in zip(values, names):
        inside, carried = F.col(n + "i"), F.col(n + "c")
        both = {"min": F.least, "max": F.greatest}[how](inside, carried) if how != "sum" else F.coalesce(
            inside + carried, inside, carried)
        scanned = scanned.withColumn(out, both)
    return scanned.drop("_blk", *[n + s for n in names for s in ("", "i", "c")])


def previous_row(
    df: DataFrame, keys: list[str], seq: str, values: dict[str, str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """For each output name, the column's value in the previous row of the key."""
    tagged = df.withColumn("_blk", _block(seq, block_rows))
    block = [*keys, "_blk"]
    packed = F.struct(F.lit(True).alias("seen"), *[F.col(c) for c in dict.fromkeys(values.values())])
    carry = tagged.groupBy(*block).agg(F.max_by(packed, F.col(seq)).alias("_last")).select(
        *block, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_carry"))
    inside = F.lag(packed).over(Window.partitionBy(*block).orderBy(seq))
    return tagged.withColumn("_in", inside).join(carry, block).withColumn(
        "_prev", F.coalesce("_in", "_carry")).withColumns(
        {out: F.col("_prev")[c] for out, c in values.items()}).drop("_blk", "_in", "_carry", "_prev")
