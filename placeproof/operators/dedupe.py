"""Duplicate photos: exact keys, near signatures, and first-match grouping without listing the pairs of a group."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeproof.functions.text import title_stem
from placeproof.operators.skew import BLOCK_ROWS, previous_row, running_before
from placeproof.session import cut_lineage

# Fixed values.
MAX_HAMMING, SIGNATURE_BITS = 6, 64


@F.pandas_udf(T.LongType())
def phash64(pixels: pd.Series) -> pd.Series:
    """64-bit perceptual hash of square grayscale matrices (flat, 32 x 32): low DCT block against its median."""
    def one(flat) -> int | None:
        if flat is None:
            return None
        side = int(round(len(flat) ** 0.5))
        image = np.asarray(flat, dtype="float64").reshape(side, side)
        k, n = np.arange(8)[:, None], np.arange(side)[None, :]
        basis = np.cos(np.pi * k * (2 * n + 1) / (2 * side))
        low = basis @ image @ basis.T
        bits = (low > np.median(low)).flatten()
        return int(np.packbits(bits).view(">u8")[0].astype("int64"))
    return pixels.map(one)


def sign_signature(vector: Column) -> Column:
    """64-bit signature from the signs of a 64-dimensional vector; bit i is set when component i is positive."""
    return F.aggregate(
        F.transform(vector, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
            F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _block_masks(max_hamming: int, spare: int) -> list[tuple[int, int]]:
    """(key number, mask): the bits are cut into max_hamming + spare blocks, so at least `spare` of them stay equal.

    Each key keeps one choice of `spare` blocks; more spare blocks make keys longer, so buckets stay small.
    """
    blocks = max_hamming + spare
    edges = [SIGNATURE_BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(blocks)]
    chosen = [sum(masks[i] for i in pick) for pick in combinations(range(blocks), spare)]
    return [(n, m - (1 << 64) if m >= 1 << 63 else m) for n, m in enumerate(chosen)]


def _keyed(signatures: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(profile_id, sig, n, bits): the block keys of distinct signatures."""
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).cast("bigint").alias("mask")) for n, m in masks])
    distinct = signatures.filter(F.col("sig").isNotNull()).select("profile_id", "sig").distinct()
    return distinct.withColumn("_k", F.explode(table)).select(
        "profile_id", "sig", F.col("_k.n").alias("n"), F.col("sig").bitwiseAND(F.col("_k.mask")).alias("bits"))


def _near(a: DataFrame, b: DataFrame, masks: list[tuple[int, int]], max_hamming: int) -> DataFrame:
    """(profile_id, sig_a, sig_b): different signatures of two keyed tables within `max_hamming` bits, each pair once.

    Keyed tables have many rows for each signature, which the size estimate of a generator doesn't count, so a broadcast would bring
    dozens of times the size limit through the driver. The join is therefore by shuffle.
    """
    differ = F.col("sig_a").bitwiseXOR(F.col("sig_b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("bigint")) == 0, n) for n, m in masks])
    return a.withColumnRenamed("sig", "sig_a").join(b.withColumnRenamed("sig", "sig_b").hint("merge"), ["profile_id", "n", "bits"]).filter(
        (F.col("sig_a") != F.col("sig_b")) & (F.bit_count(differ) <= max_hamming)).filter(F.col("n") == first).select(
        "profile_id", "sig_a", "sig_b")


def near_signatures(signatures: DataFrame, max_hamming: int = MAX_HAMMING, spare: int = 3) -> DataFrame:
    """Pairs (profile_id, sig_a, sig_b), sig_a < sig_b, of distinct signatures that differ in at most `max_hamming` bits.

    Copies are collapsed first, so a signature shared by a third of all rows is one row here. Candidates come from an
    equality join on block keys; a pair that shares several keys is checked only under its first one.
    """
    masks = _block_masks(max_hamming, spare)
    keyed = _keyed(signatures, masks)
    return _near(keyed, keyed, masks, max_hamming).filter("sig_a < sig_b")


def exact_classes(photos: DataFrame) -> DataFrame:
    """(profile_id, seq, class): one row per exact key a photo holds - file hash, title stem within its source, signature."""
    stem = title_stem(F.col("title"))
    keys = F.array_compact(F.array(
        F.when(F.col("sha1") != "", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(stem != "", F.concat_ws(":", F.lit("stem"), F.col("source"), stem)),
        F.when(F.col("sig").isNotNull(), F.concat(F.lit("sig:"), F.hex("sig")))))
    return photos.select("profile_id", "seq", F.explode(keys).alias("class"))


def exact_links(photos: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(profile_id, class, seq, previous): each copy linked to the one before it; n copies give n - 1 links, not n squared."""
    linked = previous_row(exact_classes(photos), ["profile_id", "class"], "seq", {"previous": "seq"}, block_rows)
    return linked.filter(F.col("previous").isNotNull())


def _memberships(photos: DataFrame, max_hamming: int) -> DataFrame:
    """(profile_id, class, seq, own): classes a photo may join (own), and near signature classes it only offers itself to."""
    own = exact_classes(photos).withColumn("own", F.lit(True))
    near = near_signatures(photos, max_hamming)
    ways = F.array(F.struct("sig_a", "sig_b"), F.struct(F.col("sig_b").alias("sig_a"), F.col("sig_a").alias("sig_b")))
    both = near.select("profile_id", F.inline(ways))
    offered = photos.filter(F.col("sig").isNotNull()).select("profile_id", "seq", "sig").join(
        both.withColumnRenamed("sig_a", "sig"), ["profile_id", "sig"]).select(
        "profile_id", "seq", F.concat(F.lit("sig:"), F.hex("sig_b")).alias("class"), F.lit(False).alias("own"))
    every = own.unionByName(offered)
    useful = every.groupBy("profile_id", "class").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return every.join(useful, ["profile_id", "class"], "left_semi")


def group_duplicates(
    photos: DataFrame, max_hamming: int = MAX_HAMMING, block_rows: int = BLOCK_ROWS, max_rounds: int = 200, offered: DataFrame | None = None,
) -> DataFrame:
    """(profile_id, seq, group_seq): each photo joins the earliest group holding a match, in order of arrival.

    Groups never merge, so this is not a connected component: group(x) is the least group among matches that came
    before x. Matches are always earlier rows, so repeating "take the least group offered by earlier members of my
    classes" reaches the only fixed point. A class is scanned in bounded blocks and its pairs are never listed.
    `offered` (profile_id, seq, offer) names the least group that rows outside of `photos`, earlier than all of them, offer a photo.
    """
    members = cut_lineage(_memberships(photos, max_hamming))
    start = members.select("profile_id", "seq").distinct().withColumn("grp", F.col("seq"))
    if offered is not None:
        start = start.join(offered, ["profile_id", "seq"], "full").select("profile_id", "seq", F.least("seq", "offer").alias("grp"))
    state = cut_lineage(start)
    for _ in range(max_rounds):
        offers = running_before(
            members.join(state, ["profile_id", "seq"]), ["profile_id", "class"], "seq", {"offer": F.col("grp")}, "min",
            block_rows)
        least = offers.filter("own").groupBy("profile_id", "seq").agg(F.min("offer").alias("offer"))
        moved = state.join(least, ["profile_id", "seq"], "left").select(
            "profile_id", "seq", F.least("grp", "offer").alias("next"), F.col("grp").alias("old"))
        ahead = state.select("profile_id", F.col("seq").alias("next"), F.col("grp").alias("jump"))
        jumped = cut_lineage(moved.join(ahead, ["profile_id", "next"], "left").select(
            "profile_id", "seq", F.least("next", "jump").alias("grp"), "old"))
        state = jumped.drop("old")
        if jumped.filter("grp < old").isEmpty():
            break
    else:
        raise RuntimeError("duplicate grouping did not settle")
    return photos.select("profile_id", "seq").join(state, ["profile_id", "seq"], "left").select(
        "profile_id", "seq", F.coalesce("grp", "seq").alias("group_seq"))


def group_heads(grouped: DataFrame) -> DataFrame:
    """The most confident photo of each group (first on ties) with its number of copies; input has group_seq.

    A max per group combines before the shuffle, so a huge group costs one row per task.
    """
    best = F.max(F.struct("confidence", (-F.col("seq")).alias("order"))).alias("best")
    return grouped.groupBy("profile_id", "group_seq").agg(best, (F.count("*") - 1).alias("copies")).select(
        "profile_id", "group_seq", (-F.col("best.order")).alias("head_seq"), "copies")


def group_result(grouped: DataFrame) -> DataFrame:
    """Every photo with the head of its group; heads carry their copy count, the others are duplicates of the head.

    Copies stay rows (one per duplicate) instead of an array, which a group of any size could not fit.
    """
    heads = group_heads(grouped)
    return grouped.join(heads, ["profile_id", "group_seq"]).withColumn("is_head", F.col("seq") == F.col("head_seq"))


def keep_heads(grouped: DataFrame) -> DataFrame:
    return group_result(grouped).filter("is_head").drop("is_head", "head_seq")


def class_index(photos: DataFrame, groups: DataFrame) -> DataFrame:
    """(profile_id, class, group_seq): the least group in which each exact key or signature of these photos occurs."""
    return exact_classes(photos).join(groups, ["profile_id", "seq"]).groupBy("profile_id", "class").agg(F.min("group_seq").alias("group_seq"))


def place_into_groups(new: DataFrame, index: DataFrame, max_hamming: int = MAX_HAMMING, spare: int = 3) -> DataFrame:
    """(profile_id, seq, group_seq) of new photos, all later than the stored ones of their profile, without grouping those again.

    `index` has rows of `class_index` for all stored photos; the least group of a key holds. Only keys of new photos are looked up, so
    the rounds run over new photos alone; of stored ones, the distinct signatures of the touched profiles are compared.
    """
    classes = exact_classes(new)
    met = index.join(classes.select("profile_id", "class").distinct(), ["profile_id", "class"], "left_semi").groupBy(
        "profile_id", "class").agg(F.min("group_seq").alias("offer"))
    same = classes.join(met, ["profile_id", "class"]).select("profile_id", "seq", "offer")
    signed = new.filter(F.col("sig").isNotNull()).select("profile_id", "seq", "sig")
    stored = index.filter(F.col("class").startswith("sig:")).join(
        signed.select("profile_id").distinct(), "profile_id", "left_semi").groupBy("profile_id", "class").agg(F.min("group_seq").alias(
            "offer")).select("profile_id", "offer", F.conv(F.substr("class", F.lit(5)), 16, -10).cast("bigint").alias("sig"))
    masks = _block_masks(max_hamming, spare)
    near = _near(_keyed(signed, masks), _keyed(stored, masks), masks, max_hamming).join(
        stored.withColumnRenamed("sig", "sig_b"), ["profile_id", "sig_b"]).groupBy("profile_id", "sig_a").agg(F.min("offer").alias("offer"))
    alike = signed.join(near.withColumnRenamed("sig_a", "sig"), ["profile_id", "sig"]).select("profile_id", "seq", "offer")
    offered = same.unionByName(alike).groupBy("profile_id", "seq").agg(F.min("offer").alias("offer"))
    return group_duplicates(new, max_hamming, offered=offered)
