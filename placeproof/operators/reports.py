"""Counts and coverage per profile. Every report is an aggregation that combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.functions.dates import capture_year
from placeproof.operators.ranking import reliable
from placeproof.schemas import CATEGORIES

# Fixed values.
GAP_CATEGORIES, GAP_MIN = ["dorms", "libraries", "classrooms"], 3
PARTIAL_STATES, SEARCHED_STATES = ["timeout", "error"], ["ok", "timeout"]
GENERAL_TOPICS = [
    "campus building 2024 2025", "library campus 2024 2025", "student housing dormitory 2024 2025",
    "laboratory campus 2024 2025", "sports center campus 2024 2025", "student life campus 2024 2025",
]
GAP_TOPICS = {
    "libraries": ["library", "library reading room"],
    "dorms": ["dormitory", "student housing residence hall"],
    "classrooms": ["lecture hall classroom", "laboratory building"],
}
MAX_QUERY_CHARS = 400


def _in_tier(tier: str) -> Column:
    return F.count_if(F.col("tier") == tier)


def profile_stats(photos: DataFrame) -> DataFrame:
    """`photos` carry `copies`, the number of duplicates behind each."""
    return photos.groupBy("profile_id").agg(
        F.count("*").alias("photos"), _in_tier("verified").alias("verified"), _in_tier("likely").alias("likely"),
        _in_tier("unconfirmed").alias("hidden"), F.sum("copies").cast("bigint").alias("duplicates"))


def source_metrics(images: DataFrame, shown: DataFrame, status: DataFrame) -> DataFrame:
    """Per profile and source: candidates, shown, vetoed, hidden otherwise, and how the source ended."""
    keys = ["profile_id", "source"]
    seen = images.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if("vision_veto").alias("vetoed"))
    kept = shown.groupBy(*keys).agg(F.count("*").alias("shown"))
    return status.join(seen, keys, "full_outer").join(kept, keys, "left").na.fill(
        0, ["candidates", "vetoed", "shown"]).withColumn(
        "hidden", F.greatest(F.lit(0), F.col("candidates") - F.col("shown") - F.col("vetoed")))


def category_gaps(profiles: DataFrame, photos: DataFrame, minimum: int = GAP_MIN) -> DataFrame:
    """Room categories with too few reliable photos, also where there is none at all."""
    wanted = profiles.select("profile_id", F.explode(F.array(*[F.lit(c) for c in GAP_CATEGORIES])).alias("category"))
    have = photos.filter(reliable() & F.col("category").isin(GAP_CATEGORIES)).groupBy("profile_id", "category").agg(
        F.count("*").alias("reliable"))
    return wanted.join(have, ["profile_id", "category"], "left").na.fill(0, ["reliable"]).filter(
        F.col("reliable") < minimum)


def _tabs(category: Column) -> Column:
    return F.explode(F.array(F.lit("all"), category))


def tab_counts(photos: DataFrame) -> DataFrame:
    per_category = photos.groupBy("profile_id", "category").agg(
        F.count("*").alias("every"), F.count_if(reliable()).alias("reliable"))
    return per_category.select("profile_id", _tabs(F.col("category")).alias("tab"), "every", "reliable").groupBy(
        "profile_id", "tab").agg(F.sum("every").alias("every"), F.sum("reliable").alias("reliable"))


def building_type_counts(buildings: DataFrame, name_part: str = "") -> DataFrame:
    inside = buildings.filter("inside_campus")
    matched = F.count_if(F.contains(F.lower("name"), F.lit(name_part.lower())))
    return inside.groupBy("profile_id", "type").agg(F.count("*").alias("buildings"), matched.alias("matching"))


def compare_profiles(photos: DataFrame) -> DataFrame:
    """One row per profile: verified and reliable photos per category, and reliable photos of 2024 or later."""
    counts = []
    for category in CATEGORIES:
        here = F.col("category") == category
        counts += [F.count_if(here & (F.col("tier") == "verified")).alias(f"verified_{category}"),
                   F.count_if(here & reliable()).alias(f"reliable_{category}")]
    return photos.groupBy("profile_id").agg(
        *counts, F.count_if(reliable() & (F.col("freshness") == "2024_plus")).alias("recent"))


def filled_date(taken: Column) -> Column:
    """First day a capture date can mean; used for ages only, never shown."""
    return F.try_to_date(F.concat(taken, F.when(F.length(taken) == 4, "-01-01").when(F.length(taken) == 7, "-01").otherwise(
        "")), "yyyy-MM-dd")


def quality_report(photos: DataFrame, today: Column) -> DataFrame:
    """Tier mix, reliable photos per category, share with a known capture date, recent ones and the median age in days.

    The median comes from counts per age, so a huge profile costs one row per distinct age.
    """
    dated = capture_year(F.col("date_taken")).isNotNull()
    base = photos.groupBy("profile_id").agg(
        F.count("*").alias("photos"), _in_tier("verified").alias("verified"), _in_tier("likely").alias("likely"),
        _in_tier("unconfirmed").alias("unconfirmed"),
        *[F.count_if(reliable() & (F.col("category") == c)).alias(f"reliable_{c}") for c in CATEGORIES],
        F.count_if(dated).alias("dated"), F.count_if(reliable() & (F.col("freshness") == "2024_plus")).alias("recent"))
    ages = photos.filter(reliable()).withColumn("age", F.datediff(today, filled_date(F.col("date_taken")))).filter(
        F.col("age").isNotNull()).groupBy("profile_id", "age").agg(F.count("*").alias("n"))
    median = ages.groupBy("profile_id").agg(F.percentile("age", F.lit(0.5), F.col("n")).alias("median_age_days"))
    return base.join(median, "profile_id", "left").withColumn("dated_share", F.col("dated") / F.col("photos"))


def tab_notices(photos: DataFrame, tags: list[str]) -> DataFrame:
    """Per profile and tab: photos hidden as unconfirmed, hidden by the tag filter, and whether none is recent."""
    wanted = F.array(*[F.lit(t) for t in tags]) if tags else None
    tagged = F.coalesce(F.arrays_overlap("tags", wanted), F.lit(False)) if tags else F.lit(True)
    per_category = photos.groupBy("profile_id", "category").agg(
        F.count_if(tagged & ~reliable()).alias("hidden_unconfirmed"),
        F.count_if(reliable() & ~tagged).alias("filtered_out"),
        F.count_if(reliable() & (F.col("freshness") == "2024_plus")).alias("recent"))
    return per_category.select("profile_id", _tabs(F.col("category")).alias("tab"), "*").drop("category").groupBy(
        "profile_id", "tab").agg(
        F.sum("hidden_unconfirmed").alias("hidden_unconfirmed"), F.sum("filtered_out").alias("filtered_out"),
        ((F.col("tab") != "all") & (F.sum("recent") == 0)).alias("no_recent"))


def searched_sources(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status").isin(SEARCHED_STATES))


def is_partial(status: DataFrame, ignore_forbidden_site: bool = False) -> DataFrame:
    """Profiles with a source that timed out or failed, or that hit the deadline (column `deadline_hit`)."""
    failed = F.col("status").isin(PARTIAL_STATES)
    if ignore_forbidden_site:
        failed = failed & ~((F.col("source") == "official_site") & F.contains(
            F.coalesce("detail", F.lit("")), F.lit("403")))
    return status.groupBy("profile_id").agg(F.bool_or(failed | F.coalesce("deadline_hit", F.lit(False))).alias("partial"))


def query_text(name: Column, topic: Column, website: Column) -> Column:
    """Search text for a topic, kept to the official site when it is known."""
    host = F.regexp_replace(F.coalesce(F.lower(F.try_parse_url(website, F.lit("HOST"))), F.lit("")), r"^www\.", "")
    site = F.when(host != "", F.concat(F.lit(" site:"), host)).otherwise("")
    return F.left(F.concat(F.lit('"'), name, F.lit('" '), topic, site), F.lit(MAX_QUERY_CHARS))


def gap_queries(gaps: DataFrame, profiles: DataFrame) -> DataFrame:
    """Two narrow searches per gap category; `profiles` has profile_id, name and website."""
    topics = F.create_map(*[x for c, t in GAP_TOPICS.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in t]))])
    return gaps.join(profiles, "profile_id").withColumn("topic", F.explode(F.element_at(topics, F.col("category")))).select(
        "profile_id", "category", query_text(F.col("name"), F.col("topic"), F.col("website")).alias("query"))


def general_queries(profiles: DataFrame) -> DataFrame:
    topics = F.array(*[F.lit(t) for t in GENERAL_TOPICS])
    return profiles.withColumn("topic", F.explode(topics)).select(
        "profile_id", query_text(F.col("name"), F.col("topic"), F.col("website")).alias("query"))
