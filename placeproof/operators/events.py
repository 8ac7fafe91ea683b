"""The event log of a profile build and keyed versions: fold, changes, final order, withdrawals, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.operators.skew import BLOCK_ROWS, previous_row

# Seconds an entry lives, complete and partial.
TTL_SECONDS = {
    "profile": (1800, 300), "shape": (21_600, 300), "source": (21_600, 21_600), "street_level_source": (3600, 3600),
    "verdict": (604_800, 604_800),
}
DEADLINE_S, MARGIN_S, SOURCE_BUDGET_S = 30.0, 1.0, 7.5
HISTORY_TURNS = 10


def fold_events(events: DataFrame, keys: list[str], seq: str = "seq", payload: str = "payload") -> DataFrame:
    """The last payload per key; the aggregation combines before the shuffle."""
    return events.groupBy(*keys).agg(F.max_by(payload, seq).alias(payload), F.max(seq).alias(seq))


def keep_first(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return _keep(rows, keys, F.min(F.struct(seq, *[c for c in rows.columns if c not in {*keys, seq}])))


def keep_last(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return _keep(rows, keys, F.max(F.struct(seq, *[c for c in rows.columns if c not in {*keys, seq}])))


def _keep(rows: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def version_changed(
    rows: DataFrame, keys: list[str], content: list[str], seq: str = "seq", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows whose content differs from the previous row of their key; identical repeats disappear."""
    hashed = rows.withColumn("_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    return previous_row(hashed, keys, seq, {"_before": "_hash"}, block_rows).filter(
        F.col("_before").isNull() | (F.col("_before") != F.col("_hash"))).drop("_before", "_hash")


def final_list(done: DataFrame) -> DataFrame:
    """Rows (profile_id, id, place) of `done` messages that carry their ids as a list."""
    return done.select("profile_id", F.posexplode("photo_ids").alias("place", "id"))


def keep_final(photos: DataFrame, final: DataFrame) -> DataFrame:
    """Photos of the final list with their place in it; `final` has profile_id, id and place."""
    return photos.join(final.select("profile_id", "id", "place"), ["profile_id", "id"])


def withdrawn(sent: DataFrame, final: DataFrame, keys: list[str]) -> DataFrame:
    """Provisional rows that the final set no longer has."""
    return sent.join(final.select(*keys), keys, "left_anti")


def pending_work(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys), keys, "left_anti")


def provenance(found: DataFrame) -> DataFrame:
    """One row per file: its best origin (category, subcategory, nearby), earliest within a rank, and whether it was nearby.

    `found` has profile_id, id, origin, category and seq.
    """
    rank = F.when(F.col("origin") == "category", 0).when(F.col("origin") == "subcategory", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), "seq", "origin", "category")).alias("_best")
    return found.groupBy("profile_id", "id").agg(best, F.bool_or(F.col("origin") == "nearby").alias("found_nearby")).select(
        "profile_id", "id", F.col("_best.category").alias("matched_category"),
        (F.col("_best.rank") == 1).alias("matched_subcategory"), "found_nearby")


def recent_history(turns: DataFrame, keys: list[str], n: int = HISTORY_TURNS) -> DataFrame:
    """The last `n` turns without blank ones, starting at the first turn of the user."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("turn"))
    last = turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).filter(
        F.trim("text") != "")
    so_far = Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumn("_user", F.max((F.col("role") == "user").cast("int")).over(so_far)).filter("_user = 1").drop(
        "_n", "_user")


def pick_language_version(texts: DataFrame, keys: list[str], lang: str) -> DataFrame:
    """One non-empty text per entity: the requested language, English, then the first other one."""
    rank = F.when(F.col("lang") == lang, 0).when(F.col("lang") == "en", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), "seq", "lang", "text")).alias("_best")
    return texts.filter(F.trim("text") != "").groupBy(*keys).agg(best).select(*keys, "_best.lang", "_best.text")


def alive(entries: DataFrame, now: Column, kind: str = "kind", stored_at: str = "stored_at", partial: str = "partial") -> DataFrame:
    """Stored entries that have not expired at `now`; partial ones live shorter."""
    full, short = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (long_s, short_s) in TTL_SECONDS.items():
        full = F.when(F.col(kind) == name, long_s).otherwise(full)
        short = F.when(F.col(kind) == name, short_s).otherwise(short)
    ttl = F.when(F.col(partial), short).otherwise(full)
    return entries.filter(F.unix_micros(F.col(stored_at)) + ttl.cast("bigint") * 1_000_000 > F.unix_micros(now))


def deadline_cutoff(results: DataFrame, deadline_s: float = DEADLINE_S, margin_s: float = MARGIN_S) -> tuple[DataFrame, DataFrame]:
    """Results in time, and per profile whether any came too late; `results` has profile_id and seconds after the start."""
    limit = deadline_s - margin_s
    late = results.groupBy("profile_id").agg(F.bool_or(F.col("elapsed_s") > limit).alias("deadline_hit"))
    return results.filter(F.col("elapsed_s") <= limit), late


def source_state(results: DataFrame, budget_s: float = SOURCE_BUDGET_S) -> DataFrame:
    """A source that gave rows within its budget is ok even when it was cut; one that gave none timed out."""
    in_time = F.count_if(F.col("elapsed_s") <= budget_s)
    return results.groupBy("profile_id", "source").agg(in_time.alias("count")).withColumn(
        "status", F.when(F.col("count") > 0, "ok").otherwise("timeout"))
