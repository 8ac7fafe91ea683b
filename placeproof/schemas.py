"""Row schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = "array<struct<x:double,y:double>>"
EVIDENCE = "array<struct<type:string,label:string,weight:int>>"

# Image fields and what an absent one reads as.
_IMAGE = """id string, source string, source_url string, source_domain string, full_url string, thumb_url string,
title string, description string, source_categories array<string>, matched_category string, matched_subcategory boolean,
found_by string, is_official_site boolean, author string, license string, license_url string, date_taken string,
date_uploaded string, date_source string, date_hint_year int, vision_checked boolean, vision_label string,
vision_weight int, vision_veto boolean, vision_category string, vision_source string, vision_highlight boolean,
subject_id string, subject_name string, subject_kind string, subject_building_type string, lat double, lng double,
heading_deg double, width int, height int, sha1 string"""
IMAGE_DEFAULTS = {
    "title": "", "description": "", "matched_subcategory": False, "is_official_site": False, "date_source": "unknown",
    "vision_checked": False, "vision_weight": 0, "vision_veto": False, "vision_highlight": False,
}
RAW_IMAGES = f"profile_id bigint, seq bigint, {_IMAGE}"
REGISTRY_HITS = (
    """query_id bigint, ord bigint, source string, name string, aliases array<string>, city string, country string, lat double,
    lng double, website string, ror_id string, wikidata_ids array<string>, commons_category string, chosen boolean,
    sitelinks int""")
CAMPUS = (
    f"profile_id bigint, names array<string>, lat double, lng double, ring {RING}, official_domains array<string>")
BUILDINGS = (
    f"""profile_id bigint, ord bigint, building_id string, name string, type string, ring {RING}, height_m double,
    levels int, inside_campus boolean""")

# Allowed codes.
TIERS = ["verified", "likely", "unconfirmed"]
CATEGORIES = ["campus", "dorms", "classrooms", "libraries", "city"]
TAGS = ["dorm", "sport", "labs", "student_life"]
FRESHNESS = ["2024_plus", "2020_2023", "older", "historic", "date_unknown"]
STATES = ["pending", "ok", "timeout", "error", "skipped"]


def conform(df: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """Exactly the schema's columns in order: missing ones added, nulls with a default filled, types cast."""
    defaults = defaults or {}
    columns = []
    for field in T.StructType.fromDDL(schema).fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        if field.name == "source_categories":
            value = F.coalesce(value.cast(field.dataType), F.array().cast(field.dataType))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def as_images(df: DataFrame) -> DataFrame:
    return conform(df, RAW_IMAGES, IMAGE_DEFAULTS)
