"""Inputs of the registered queries, derived from the given tables.

The derivations are plain arithmetic written once as SQL expressions that Spark and other engines read alike, so a check
in another engine starts from the same rows. Nothing is filtered or cut: every row and every whole text takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.schemas import as_images

TODAY = "2026-09-17"

# Words put into titles and categories, so that every rule meets matching rows.
TITLE_WORDS = [
    "Main building", "Library reading room", "Student dormitory", "Lecture hall", "Chemistry laboratory", "Sports stadium",
    "Portrait of a guest", "Conference hall", "Protest march", "Police station", "Speech Hall", "University logo",
    "Poster", "Hospital entrance", "High School gate", "Bacteria sample", "Pizza at the cafe", "Campus panorama",
    "Women in Science", "Festival of clubs", "Scan of a page", "Quiet street", "Old gate", "Professor at work",
]
CATEGORY_WORDS = [
    "Buildings", "Hospitals in the region", "Portraits of staff", "Events at the campus", "Logos", "Libraries", "Student life",
    "1920 births", "Laboratories",
]
RING = [(-6, -6), (0, -3), (6, -6), (3, 0), (6, 6), (0, 3), (-6, 6), (-3, 0), (-6, -6)]
BUILDING_KINDS = ["academic", "dorm", "library", "sport", "lab", "food", "other"]
DATES = ["2024-05-02", "2024-02", "2021", "1932-07-01", "2012-11-30", "2025-01-15", "2019-06", "2020-03-03"]
RAW_DATES = ["2024-05-02", "2024-02", "2021", "2024-02-31", "+2019-03-04T10:20:30Z", "2031-01-01", "May 2020", "2020-13",
             "0000", "1999-12-31 08:00", "  2018  "]


def case(key: str, values: list, default: str = "NULL") -> str:
    """A CASE that picks the value by number; text values are quoted."""
    def sql(value) -> str:
        return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {sql(v)}" for i, v in enumerate(values)) + f" ELSE {default} END"


P = "CAST(doc_id % 25 AS STRING)"
IMAGE = {
    "profile_id": "doc_id % 25",
    "seq": "doc_id",
    "id": "'img-' || CAST(doc_id AS STRING)",
    "source": case("doc_id % 5", ["wikimedia_commons", "mapillary", "official_site", "openverse", "web_search"]),
    "source_url": "'https://pages.example.com/' || CAST(doc_id % 211 AS STRING)",
    "source_domain": f"CASE WHEN doc_id % 11 = 0 THEN 'www.u' || {P} || '.example.org' WHEN doc_id % 11 = 1 THEN "
                     "'www.mapillary.com' ELSE 'photos.example.com' END",
    "full_url": "'https://img.example.com/' || CAST(doc_id AS STRING) || '.jpg'",
    "thumb_url": "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'https://img.example.com/t' || CAST(doc_id AS STRING) END",
    "title": f"'File:' || {case('doc_id % 24', TITLE_WORDS)} || CASE WHEN doc_id % 6 = 0 THEN ' NATION ' || {P} "
             f"WHEN doc_id % 6 = 1 THEN ' N' || {P} ELSE '' END || ' ' || lang || "
             "CASE doc_id % 10 WHEN 3 THEN ' (cropped)' WHEN 7 THEN ' (2)' ELSE '' END || '.jpg'",
    "description": "text",
    "category_a": case("doc_id % 9", CATEGORY_WORDS),
    "category_b": f"CASE WHEN doc_id % 2 = 0 THEN 'Views of NATION ' || {P} ELSE 'Streets' END",
    "matched_category": f"CASE WHEN doc_id % 18 = 0 THEN 'Library of NATION ' || {P} WHEN doc_id % 9 = 0 THEN 'Hospital of "
                        f"the town' WHEN doc_id % 3 = 0 THEN 'NATION ' || {P} ELSE NULL END",
    "matched_subcategory": "doc_id % 9 = 0",
    "is_official_site": "doc_id % 31 = 0",
    "author": "CASE WHEN doc_id % 4 = 1 THEN NULL ELSE 'author ' || CAST(doc_id % 13 AS STRING) END",
    "license": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'CC BY 4.0' END",
    "date_taken": case("doc_id % 11", DATES),
    "date_uploaded": "CASE WHEN doc_id % 2 = 0 THEN '2023-03-04' ELSE NULL END",
    "date_source": case("doc_id % 4", ["exif", "structured_data", "unknown", "source_metadata"]),
    "date_hint_year": "CASE WHEN doc_id % 17 = 0 THEN 1815 WHEN doc_id % 17 = 1 THEN 2001 ELSE NULL END",
    "vision_checked": "doc_id % 8 <> 5",
    "vision_label": case("doc_id % 7", [None, "campus_place", "not_campus_place", "inconclusive"]),
    "vision_weight": case("doc_id % 7", [0, 12, -20, 0], "0"),
    "vision_veto": "doc_id % 28 = 9",
    "vision_category": "CASE doc_id % 14 WHEN 1 THEN 'libraries' WHEN 8 THEN 'dorms' ELSE NULL END",
    "vision_source": "CASE WHEN doc_id % 2 = 0 THEN 'review' ELSE 'prompts' END",
    "vision_highlight": "doc_id % 21 = 4",
    "subject_name": "CASE WHEN doc_id % 12 = 0 THEN 'Old Hall' ELSE NULL END",
    "subject_kind": "CASE WHEN doc_id % 12 = 0 THEN 'building' ELSE NULL END",
    "subject_building_type": "CASE WHEN doc_id % 24 = 0 THEN 'dorm' ELSE NULL END",
    "lat": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 37e0 + (doc_id % 25) * 5e-2 + ((doc_id * 7919) % 4001 - 2000) / 2e5 + "
           "CASE WHEN doc_id % 13 = 0 THEN 2e-1 ELSE 0e0 END END",
    "lng": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 127e0 + (doc_id % 25) * 1e-1 + ((doc_id * 10473) % 4001 - 2000) / 2e5 "
           "END",
    "heading_deg": "CASE WHEN doc_id % 3 = 1 THEN (doc_id % 360) * 1e0 ELSE NULL END",
    "width": "CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 100 + doc_id % 700 END",
    "height": "CASE WHEN doc_id % 8 = 7 THEN NULL ELSE 150 + (doc_id * 3) % 500 END",
    "sha1": "CASE WHEN doc_id % 20 = 3 THEN 'h' || CAST(doc_id % 60 AS STRING) ELSE NULL END",
}
CAMPUS = {
    "profile_id": "n_nationkey",
    "name": "replace(n_name, '_', ' ')",
    "lat": "37e0 + n_nationkey * 5e-2",
    "lng": "127e0 + n_nationkey * 1e-1",
    "outlined": "n_nationkey % 6 <> 5",
}
BUILDING = {
    "profile_id": "p_partkey % 25",
    "ord": "p_partkey",
    "building_id": "'b' || CAST(p_partkey AS STRING)",
    "name": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END",
    "type": case("p_partkey % 7", BUILDING_KINDS),
    "cx": "127e0 + (p_partkey % 25) * 1e-1 + ((p_partkey * 31) % 161 - 80) / 1e4 + 37e-7",
    "cy": "37e0 + (p_partkey % 25) * 5e-2 + ((p_partkey * 57) % 161 - 80) / 1e4",
    "hw": "2e-4 + (p_partkey % 5) * 1e-4",
    "hh": "2e-4 + (p_partkey % 3) * 1e-4",
    "height_m": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size * 1e0 END",
    "levels": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size % 9 END",
    "inside_campus": "p_partkey % 3 <> 0",
}
USAGE = {
    "seq": "event_id",
    "day": "CAST(ts AS DATE)",
    "user_id": "user_id",
    "model": "CASE event_type WHEN 'click' THEN 'small' WHEN 'view' THEN 'medium' WHEN 'error' THEN 'other' ELSE 'large' END",
    "input_tokens": "CAST(floor(value * 100) AS BIGINT)",
    "output_tokens": "event_id % 1000",
    "web_searches": "event_id % 3",
}
STATUS = {
    "profile_id": "user_id",
    "seq": "event_id",
    "source": "event_type",
    "status": case("event_id % 5", ["pending", "ok", "timeout", "error", "skipped"]),
    "took_ms": "CAST(floor(value * 10) AS BIGINT)",
    "elapsed_s": "value / 1e1",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def select_sql(name: str, columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {name}"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").selectExpr(
        *[f"{e} AS {c}" for c, e in IMAGE.items()])
    return as_images(rows.withColumn("source_categories", F.array("category_a", "category_b")))


def campus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "nation", CAMPUS)
    key = F.col("profile_id").cast("string")
    corners = [F.struct((F.col("lng") + dx / 1e3).alias("x"), (F.col("lat") + dy / 1e3).alias("y")) for dx, dy in RING]
    return rows.select(
        F.col("profile_id").cast("bigint").alias("profile_id"), F.array("name", F.concat(F.lit("N"), key)).alias("names"),
        "lat", "lng", F.when(F.col("outlined"), F.array(*corners)).alias("ring"),
        F.array(F.concat(F.lit("u"), key, F.lit(".example.org"))).alias("official_domains"))


def box_ring(w, s, e, n):
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "part", BUILDING)
    cx, cy, hw, hh = (F.col(c) for c in ("cx", "cy", "hw", "hh"))
    return rows.select(
        "profile_id", "ord", "building_id", "name", "type", box_ring(cx - hw, cy - hh, cx + hw, cy + hh).alias("ring"),
        "height_m", "levels", "inside_campus")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "events", USAGE)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "events", STATUS)


# The same derivations as named queries for the checking engine.
SQL = {
    "img": select_sql("documents", IMAGE),
    "campus": select_sql("nation", CAMPUS),
    "bldg": select_sql("part", BUILDING),
    "usage": select_sql("events", USAGE),
    "status": select_sql("events", STATUS),
    "edges": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, (a, b) in enumerate(zip(RING, RING[1:]))) + ") AS v(i, ax, ay, zx, zy)",
}


def with_views(*names: str) -> str:
    return ", ".join(f"{n} AS ({SQL[n]})" for n in names)
