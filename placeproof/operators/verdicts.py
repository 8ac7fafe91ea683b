"""Visual verdicts: from prompt similarities, from a model's structured review, and joined back to image rows in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.operators.skew import running_before

# Fixed values.
UNCLEAR_MARGIN, VETO_MARGIN = 0.03, 0.07
PROMPT_POSITIVE, REVIEW_POSITIVE, NEGATIVE = 12, 16, -20
POSITIVE_CATEGORIES = ["campus", "libraries", "classrooms", "dorms"]
NEGATIVE_PROMPTS = 5
REVIEW_SURE, REVIEW_VETO_SURE = 70, 90
PLACE_LABELS = ["campus_place", "building_interior"]
ROOM_CATEGORIES = ["dorms", "classrooms", "libraries"]
VERDICT_TTL_DAYS = 7
REVIEW_SCHEMA = "label string, category string, confidence int, highlight boolean"


def _verdict(name: str, weight: int, veto: Column, category: Column, highlight: Column, source: str) -> Column:
    return F.struct(
        F.lit(name).alias("label"), F.lit(weight).alias("weight"), veto.alias("veto"),
        category.cast("string").alias("category"), highlight.alias("highlight"), F.lit(source).alias("source"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def prompt_verdict(similarities: Column) -> Column:
    """Verdict from an array of similarities: the positive prompts in category order, then the negative ones."""
    positives = F.slice(similarities, 1, len(POSITIVE_CATEGORIES))
    best = F.array_max(positives)
    margin = best - F.array_max(F.slice(similarities, len(POSITIVE_CATEGORIES) + 1, NEGATIVE_PROMPTS))
    category = F.element_at(F.array(*[F.lit(c) for c in POSITIVE_CATEGORIES]), F.array_position(positives, best).cast("int"))
    no, nothing = F.lit(False), F.lit(None)
    return (
        F.when(margin <= -UNCLEAR_MARGIN, _verdict(
            "not_campus_place", NEGATIVE, margin <= -VETO_MARGIN, nothing, no, "prompts"))
        .when(margin >= UNCLEAR_MARGIN, _verdict(
            "campus_place", PROMPT_POSITIVE, no, F.nullif(category, F.lit("campus")), no, "prompts"))
        .otherwise(_verdict("inconclusive", 0, no, nothing, no, "prompts"))
    )


def review_verdict(answer: Column) -> Column:
    """Verdict from a review answer as JSON text."""
    parsed = F.from_json(answer, REVIEW_SCHEMA)
    label, sure = parsed["label"], parsed["confidence"]
    place = label.isin(PLACE_LABELS)
    room = F.when(parsed["category"].isin(ROOM_CATEGORIES), parsed["category"])
    no, nothing = F.lit(False), F.lit(None)
    return F.when(label.isNotNull(), (
        F.when(place & (sure >= REVIEW_SURE), _verdict(
            "campus_place", REVIEW_POSITIVE, no, room, F.coalesce(parsed["highlight"], no), "review"))
        .when(~place & (sure >= REVIEW_SURE), _verdict(
            "not_campus_place", NEGATIVE, (label == "not_a_photo") & (sure >= REVIEW_VETO_SURE), nothing, no, "review"))
        .otherwise(_verdict("inconclusive", 0, no, nothing, no, "review"))
    ))


def merge_verdicts(local: Column, review: Column) -> Column:
    """The review wins unless it is inconclusive and a local verdict exists."""
    return F.when(review.isNull() | ((review["label"] == "inconclusive") & local.isNotNull()), local).otherwise(review)


def apply_verdict(images: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Image rows with the verdict's fields set; rows without a verdict keep theirs."""
    given = F.col(verdict).isNotNull()
    fields = {"vision_label": "label", "vision_weight": "weight", "vision_veto": "veto", "vision_category": "category",
              "vision_source": "source", "vision_highlight": "highlight"}
    return images.withColumns({
        "vision_checked": given | F.col("vision_checked"),
        **{c: F.when(given, F.col(verdict)[f]).otherwise(F.col(c)) for c, f in fields.items()}}).drop(verdict)


HOUR_MICROS = 3_600_000_000


def cached_verdicts(
    images: DataFrame, stored: DataFrame, key: str = "full_url", asked_at: str = "asked_at", ttl_days: int = VERDICT_TTL_DAYS
) -> DataFrame:
    """Images with the latest stored verdict of their key known at `asked_at` and not older than the time to live.

    `stored` has the key, `checked_at` and `verdict`. Requests and verdicts are one sequence in time per key, scanned in
    hourly blocks: the cost grows with the rows, also for a key that holds most requests and most verdicts.
    """
    micros = F.unix_micros(asked_at)
    kind = stored.schema["verdict"].dataType.simpleString()
    hit = F.struct(F.col("checked_at").alias("at"), F.col("verdict").alias("verdict"))
    asked = images.select(
        F.col(key).alias("_key"), (micros * 2 + 1).alias("_at"), F.struct(*images.columns).alias("_row"),
        F.lit(None).cast(f"struct<at:timestamp,verdict:{kind}>").alias("_hit"))
    known = stored.select(
        F.col(key).alias("_key"), (F.unix_micros("checked_at") * 2).alias("_at"),
        F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), hit.alias("_hit"))
    scanned = running_before(
        asked.unionByName(known), ["_key"], "_at", {"_last": F.col("_hit")}, "max", 2 * HOUR_MICROS).filter(
        F.col("_row").isNotNull())
    alive = F.col("_last.at") > F.col(f"_row.{asked_at}") - F.expr(f"INTERVAL {ttl_days} DAYS")
    return scanned.select("_row.*", F.when(alive, F.col("_last.verdict")).alias("verdict"))
