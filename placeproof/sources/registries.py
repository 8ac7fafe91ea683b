"""Registry payloads (JSON text in `payload`) to hits and university records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.functions import rules
from placeproof.schemas import REGISTRY_HITS, conform

# Fixed values.
HITS_PER_QUERY = 10
COUNTRY, LOCATED_IN, POINT, WEBSITE, MEDIA_CATEGORY, REGISTRY_ID = "P17", "P131", "P625", "P856", "P373", "P6782"
ARTICLE_SITES = ["enwiki", "ruwiki", "kowiki"]
ORGANISATION = """id string, types array<string>, names array<struct<value:string,types:array<string>>>,
locations array<struct<geonames_details:struct<name:string,country_name:string,lat:double,lng:double>>>,
links array<struct<type:string,value:string>>, external_ids array<struct<type:string,all:array<string>>>"""
ENTITY = """id string, missing string, labels map<string,struct<value:string>>,
aliases map<string,array<struct<value:string>>>, descriptions map<string,struct<value:string>>,
claims map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>, sitelinks map<string,struct<title:string>>"""


def normalize_registry(payloads: DataFrame) -> DataFrame:
    """Organisation records (query_id, ord, payload, chosen) to hits; at most ten educational ones per query."""
    org = payloads.withColumn("o", F.from_json("payload", ORGANISATION))
    shown = F.get(F.filter("o.names", lambda n: F.array_contains(n["types"], "ror_display")), F.lit(0))["value"]
    place = F.get("o.locations", F.lit(0))["geonames_details"]
    hits = org.filter(F.array_contains("o.types", "education")).withColumn("name", shown).filter(
        F.col("name").isNotNull() & (F.col("name") != "")).select(
        "query_id", "ord", F.lit("registry").alias("source"), "name",
        F.filter(F.transform("o.names", lambda n: n["value"]), lambda v: v != F.col("name")).alias("aliases"),
        place["name"].alias("city"), place["country_name"].alias("country"), place["lat"].alias("lat"),
        place["lng"].alias("lng"),
        F.get(F.filter("o.links", lambda l: l["type"] == "website"), F.lit(0))["value"].alias("website"),
        F.substring_index("o.id", "/", -1).alias("ror_id"),
        F.coalesce(F.get(F.filter("o.external_ids", lambda e: e["type"] == "wikidata"), F.lit(0))["all"],
                   F.array().cast("array<string>")).alias("wikidata_ids"),
        F.coalesce("chosen", F.lit(False)).alias("chosen"), F.lit(0).alias("sitelinks"))
    first = Window.partitionBy("query_id").orderBy("ord")
    return conform(hits.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= HITS_PER_QUERY), REGISTRY_HITS)


def claim(entity: Column, prop: str) -> Column:
    """The first non-null value of a property, as JSON text."""
    values = F.transform(
        F.element_at(entity["claims"], F.lit(prop)), lambda c: c["mainsnak"]["datavalue"]["value"])
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def claim_ids(entity: Column, prop: str) -> Column:
    values = F.transform(
        F.element_at(entity["claims"], F.lit(prop)), lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id"))
    return F.coalesce(F.filter(values, lambda v: v.isNotNull()), F.array().cast("array<string>"))


def entity_label(entity: Column, lang: Column | str) -> Column:
    labels = entity["labels"]
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.coalesce(
        F.element_at(labels, lang)["value"], F.element_at(labels, F.lit("en"))["value"],
        F.element_at(labels, F.lit("ru"))["value"], F.get(F.map_values(labels), F.lit(0))["value"])


def _values(items: Column) -> Column:
    return F.transform(items, lambda v: v["value"])


def _label_values(entity: Column) -> Column:
    return F.coalesce(_values(F.map_values(entity["labels"])), F.array().cast("array<string>"))


def is_education(entity: Column) -> Column:
    """A registry id, or an English description (any, without an English one) that names a place of education."""
    described = F.coalesce(
        F.element_at(entity["descriptions"], F.lit("en"))["value"],
        F.get(F.map_values(entity["descriptions"]), F.lit(0))["value"])
    return claim(entity, REGISTRY_ID).isNotNull() | rules.matches(F.lower(described), rules.EDUCATION)


def normalize_entities(payloads: DataFrame, lang: str = "en") -> DataFrame:
    """Entity records (query_id, ord, payload) to hits; place ids stay as `city_id` and `country_id` for a label join."""
    read = payloads.withColumn("e", F.from_json("payload", ENTITY)).filter(is_education(F.col("e")))
    e = F.col("e")
    named = read.withColumn("name", entity_label(e, lang)).filter(F.col("name").isNotNull())

    def aliases(code: str) -> Column:
        return F.coalesce(_values(F.element_at(e["aliases"], F.lit(code))), F.array().cast("array<string>"))

    others = F.filter(_label_values(e), lambda v: v != F.col("name"))
    point = claim(e, POINT)
    hits = named.select(
        "query_id", "ord", F.lit("entity").alias("source"), "name",
        F.array_distinct(F.concat(aliases("en"), aliases("ru"), others)).alias("aliases"),
        F.get_json_object(claim(e, LOCATED_IN), "$.id").alias("city_id"),
        F.get_json_object(claim(e, COUNTRY), "$.id").alias("country_id"),
        F.get_json_object(point, "$.latitude").cast("double").alias("lat"),
        F.get_json_object(point, "$.longitude").cast("double").alias("lng"), claim(e, WEBSITE).alias("website"),
        claim(e, REGISTRY_ID).alias("ror_id"), F.array(e["id"]).alias("wikidata_ids"),
        claim(e, MEDIA_CATEGORY).alias("commons_category"), F.lit(False).alias("chosen"),
        F.coalesce(F.size(F.map_keys(e["sitelinks"])), F.lit(0)).alias("sitelinks"))
    wide = conform(hits, REGISTRY_HITS + ", city_id string, country_id string")
    return wide


def university_records(payloads: DataFrame, lang: str = "en") -> DataFrame:
    """One record per entity; entities marked missing are dropped."""
    read = payloads.withColumn("e", F.from_json("payload", ENTITY)).filter(
        F.col("e.id").isNotNull() & F.col("e.missing").isNull())
    e = F.col("e")
    alias_values = F.coalesce(
        _values(F.flatten(F.map_values(e["aliases"]))), F.array().cast("array<string>"))
    names = F.filter(F.array_distinct(F.concat(_label_values(e), alias_values)), lambda n: n.isNotNull() & (n != ""))
    point = claim(e, POINT)
    name = F.coalesce(entity_label(e, lang), e["id"])
    titles = F.map_filter(e["sitelinks"], lambda k, v: k.isin(ARTICLE_SITES))
    return read.select(
        e["id"].alias("wikidata_id"), name.alias("name"), F.coalesce(entity_label(e, "en"), name).alias("name_en"),
        names.alias("names"), F.transform_values(e["labels"], lambda k, v: v["value"]).alias("names_by_language"),
        F.get_json_object(point, "$.latitude").cast("double").alias("lat"),
        F.get_json_object(point, "$.longitude").cast("double").alias("lng"), claim(e, WEBSITE).alias("website"),
        claim(e, MEDIA_CATEGORY).alias("commons_category"), claim(e, REGISTRY_ID).alias("ror_id"),
        F.get(claim_ids(e, LOCATED_IN), F.lit(0)).alias("city_id"), F.get(claim_ids(e, COUNTRY), F.lit(0)).alias("country_id"),
        F.transform_values(F.transform_keys(titles, lambda k, v: F.regexp_replace(k, "wiki$", "")), lambda k, v: v["title"])
        .alias("wikipedia_titles"))
