"""Rows about one university: search plan, summary row, numbered facts and summary sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.functions import geo
from placeproof.operators.ranking import reliable
from placeproof.operators.skew import BLOCK_ROWS, ordered_position
from placeproof.schemas import CATEGORIES

# Fixed values.
PLAN_LANGUAGES, MAX_PLAN_NAMES, MAX_CENTERS, MAX_PROFILE_ALIASES = ["en", "ko", "ru", "kk"], 16, 9, 20


def plan_names(uni_names: Column, name: Column, name_en: Column, by_language: Column) -> Column:
    first = [name_en, name, *[F.element_at(by_language, F.lit(code)) for code in PLAN_LANGUAGES]]
    ordered = F.filter(F.concat(F.array(*first), uni_names), lambda n: n.isNotNull() & (n != ""))
    return F.slice(F.array_distinct(ordered), 1, MAX_PLAN_NAMES)


def build_search_plan(universities: DataFrame) -> DataFrame:
    """Names, box and covering circles per university; one row per profile."""
    ring = F.col("ring")
    return universities.select(
        "profile_id",
        plan_names(F.col("names"), F.col("name"), F.col("name_en"), F.col("names_by_language")).alias("names"),
        F.when(ring.isNotNull(), geo.bbox_of(ring)).alias("box"),
        F.slice(geo.search_centers(ring, F.col("lat"), F.col("lng")), 1, MAX_CENTERS).alias("centers"))


def search_subjects(
    universities: DataFrame, buildings: DataFrame, discovered: DataFrame, centers: DataFrame
) -> DataFrame:
    """What to search for, one row each: the university, its named inside buildings, discovered items, the city.

    Rows instead of one list per profile, so a campus of any size stays spread over tasks.
    """
    none = F.lit(None).cast("string")
    self_rows = universities.select(
        "profile_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.lit("university").alias("kind"),
        F.col("name").alias("subject"), none.alias("building_type"))
    inside = buildings.filter(F.col("inside_campus") & (F.col("name") != "")).select(
        "profile_id", F.lit(1).alias("part"), "ord", F.lit("building").alias("kind"), F.col("name").alias("subject"),
        F.col("type").alias("building_type"))
    found = discovered.select(
        "profile_id", F.lit(2).alias("part"), "ord", F.lit("building").alias("kind"),
        F.get("names", F.lit(0)).alias("subject"), "building_type")
    city = centers.select(
        "profile_id", F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.lit("city").alias("kind"),
        F.col("center_name").alias("subject"), none.alias("building_type"))
    return self_rows.unionByName(inside).unionByName(found).unionByName(city)


def attach_subject(images: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subject of the category a file was found in; the last subject of a category wins."""
    fields = ["subject_id", "subject_name", "subject_kind", "subject_building_type"]
    last = subjects.groupBy("profile_id", "category").agg(F.max(F.struct("ord", *fields)).alias("_s")).select(
        "profile_id", F.col("category").alias("matched_category"), *[F.col(f"_s.{f}").alias(f) for f in fields])
    kept = images.drop(*fields)
    return kept.join(last, ["profile_id", "matched_category"], "left")


def university_profile(universities: DataFrame, shapes: DataFrame, centers: DataFrame, routes: DataFrame) -> DataFrame:
    """One summary row per university; a route is shown only when there is a city centre."""
    joined = universities.join(shapes, "profile_id", "left").join(centers, "profile_id", "left").join(
        routes, "profile_id", "left")
    centered = F.col("center_name").isNotNull()
    km = F.bround(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("center_lat"), F.col("center_lng")) / 1000, 1)
    return joined.select(
        "profile_id", "name",
        F.slice(F.filter("names", lambda n: n != F.col("name")), 1, MAX_PROFILE_ALIASES).alias("aliases"),
        F.coalesce("center_name", "city").alias("city"), "country", "website", "lat", "lng", "area_km2",
        F.when(centered, km).alias("center_km"),
        F.when(centered, F.bround("road_km", 1)).alias("road_km"),
        F.when(centered, geo.drive_minutes(F.col("drive_s"))).alias("drive_min"),
        F.when(centered, geo.walk_minutes(F.col("road_km"))).alias("walk_min"))


def profile_facts(profiles: DataFrame, photos: DataFrame) -> DataFrame:
    """Numbered fact rows per profile; absent facts leave no gap in the numbering.

    `profiles` has the summary row's columns plus `summary`.
    """
    counts = photos.groupBy("profile_id").agg(
        *[F.count_if(reliable() & (F.col("category") == c)).alias(f"n_{c}") for c in CATEGORIES],
        F.count_if(reliable() & (F.col("freshness") == "2024_plus")).alias("n_recent"))
    joined = profiles.join(counts, "profile_id", "left").na.fill(0, [*[f"n_{c}" for c in CATEGORIES], "n_recent"])

    def shown(column: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))

    route = F.when(F.col("road_km").isNotNull(), F.concat(
        F.lit("; by road "), F.format_string("%.1f", "road_km"), F.lit(" km, "), F.col("drive_min").cast("string"),
        F.lit(" min by car, "), F.col("walk_min").cast("string"), F.lit(" min on foot"))).otherwise("")
    facts = F.array_compact(F.array(
        F.concat(F.col("name"), F.lit("; city: "), shown("city"), F.lit("; country: "), shown("country"),
                 F.lit("; website: "), shown("website")),
        F.nullif("summary", F.lit("")),
        F.when(F.col("center_km").isNotNull(), F.concat(
            F.lit("Distance to the centre of "), shown("city"), F.lit(": "), F.format_string("%.1f", "center_km"),
            F.lit(" km"), route)),
        F.when(F.col("area_km2") > 0, F.concat(F.lit("Campus area: "), F.format_string("%.2f", "area_km2"), F.lit(" km2"))),
        F.concat(F.lit("Reliable photos: "), F.concat_ws(", ", *[
            F.concat(F.lit(f"{c} "), F.col(f"n_{c}").cast("string")) for c in CATEGORIES]),
            F.lit("; from 2024 on "), F.col("n_recent").cast("string"))))
    return joined.select("profile_id", F.posexplode(facts).alias("no", "fact")).withColumn("no", F.col("no") + 1)


def summary_sources(encyclopedia: DataFrame, images: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Numbered source texts: the encyclopedia extract first, then each distinct official-site description once."""
    first = encyclopedia.filter(F.trim("text") != "").select(
        "profile_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("seq"), "text")
    site = images.filter((F.col("source") == "official_site") & (F.trim("description") != "")).groupBy(
        "profile_id", F.col("description").alias("text")).agg(F.min("seq").alias("seq")).select(
        "profile_id", F.lit(1).alias("part"), "seq", "text")
    return ordered_position(first.unionByName(site), ["profile_id"], [F.col("part")], "seq", "no", block_rows).select(
        "profile_id", "no", "text")


def extractive_summary(texts: DataFrame) -> DataFrame:
    """The first non-empty extract per profile with citation 1; profiles without one get an empty text.

    `texts` has profile_id, seq, is_extract and text.
    """
    usable = F.col("is_extract") & (F.col("text") != "")
    return texts.groupBy("profile_id").agg(F.min_by(
        F.when(usable, F.col("text")), F.when(usable, F.col("seq"))).alias("text")).select(
        "profile_id", F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("text").isNotNull(), 1).alias("citation"))
