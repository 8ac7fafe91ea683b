"""Entity resolution: hits of two registries to ranked candidates per query. All joins are equalities; nothing is compared
outside its query, and only names that share a query reach the Python ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.functions.geo import haversine_m
from placeproof.functions.text import name_similarity, normalize_text
from placeproof.session import cut_lineage

# Fixed values.
MAX_CANDIDATES, MAX_ALIASES = 5, 12
MIN_SIMILARITY, RESOLVED_SIMILARITY = 0.6, 0.9
RESOLVED_SCORE, RESOLVED_GAP, NOT_FOUND_BELOW = 0.7, 0.1, 0.55
SAME_PLACE_KM = 15.0
CORRECTED_FACTOR, CHOSEN_SIMILARITY = 0.95, 0.95
AFTER_LEFT = 1 << 32
SIMILARITY_SHARE, BOTH_SHARE, POPULARITY_SHARE, POPULAR_LINKS = 0.55, 0.15, 0.3, 150


def all_names() -> Column:
    return F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))


def same_organisation(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, l_ord, r_ord) that share a registry id, an entity id, or a name within 15 km."""
    l, r = left.withColumnRenamed("ord", "l_ord"), right.withColumnRenamed("ord", "r_ord")
    pair = ["query_id", "l_ord", "r_ord"]
    by_registry = l.filter(F.col("ror_id") != "").select("query_id", "l_ord", "ror_id").join(
        r.filter(F.col("ror_id") != "").select("query_id", "r_ord", "ror_id"), ["query_id", "ror_id"]).select(pair)
    by_entity = l.select("query_id", "l_ord", F.explode("wikidata_ids").alias("qid")).join(
        r.select("query_id", "r_ord", F.explode("wikidata_ids").alias("qid")), ["query_id", "qid"]).select(pair)
    named = l.select("query_id", "l_ord", F.col("lat").alias("l_lat"), F.col("lng").alias("l_lng"), F.explode(
        F.array_distinct(F.transform(all_names(), normalize_text))).alias("norm"))
    by_name = named.join(r.select("query_id", "r_ord", "lat", "lng", normalize_text(F.col("name")).alias("norm")), [
        "query_id", "norm"]).filter(
        haversine_m(F.col("l_lat"), F.col("l_lng"), F.col("lat"), F.col("lng")) / 1000 <= SAME_PLACE_KM).select(pair)
    return by_registry.union(by_entity).union(by_name).distinct()


def _one_to_one(edges: DataFrame) -> DataFrame:
    """Each right hit in order takes its first left hit that no earlier one took.

    An edge that is the first of both its ends is certain, and the edges of taken ends fall away; this goes on until no
    edge is left. Rounds are joins over narrow rows, so a query may have any number of hits.
    """
    left, picked = cut_lineage(edges), None
    while not left.isEmpty():
        of_right = left.groupBy("query_id", "r_ord").agg(F.min("l_ord").alias("l_ord"))
        of_left = left.groupBy("query_id", "l_ord").agg(F.min("r_ord").alias("r_ord"))
        sure = cut_lineage(of_right.join(of_left, ["query_id", "l_ord", "r_ord"]))
        picked = sure if picked is None else picked.unionByName(sure)
        left = cut_lineage(left.join(sure.select("query_id", "l_ord"), ["query_id", "l_ord"], "left_anti").join(
            sure.select("query_id", "r_ord"), ["query_id", "r_ord"], "left_anti").select("query_id", "l_ord", "r_ord"))
    return left if picked is None else picked


def merge_registries(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per organisation: each right hit joins the first left hit of its query that it matches and is still free.

    `group_ord` is the left hit's place, or that of a right hit alone after all left ones. How many hits a lookup returns is
    the lookup's affair (`sources.registries`); all that come take part.
    """
    picks = _one_to_one(same_organisation(left, right))
    columns = [c for c in left.columns if c != "query_id"]
    a = left.select("query_id", F.col("ord").alias("l_ord"), F.struct(*columns).alias("left"))
    b = right.select("query_id", F.col("ord").alias("r_ord"), F.struct(*columns).alias("right"))
    return a.join(picks, ["query_id", "l_ord"], "left").join(b, ["query_id", "r_ord"], "full_outer").select(
        "query_id", "left", "right", F.coalesce("l_ord", F.col("r_ord") + F.lit(AFTER_LEFT)).alias("group_ord"))


def _side_names(side: str) -> Column:
    return F.when(F.col(side).isNotNull(), F.concat(F.array(F.col(side)["name"]), F.coalesce(
        F.col(side)["aliases"], F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))


def score_candidates(merged: DataFrame, queries: DataFrame) -> DataFrame:
    """`queries` has query_id, query and corrected_query; adds name similarity and the match score."""
    asked = merged.join(queries, "query_id")
    names = asked.select("query_id", "group_ord", "query", "corrected_query", F.explode(F.array_distinct(F.concat(
        _side_names("left"), _side_names("right")))).alias("name")).filter(F.col("name") != "")
    likeness = names.select("query_id", "group_ord", name_similarity(F.col("query"), F.col("name")).alias("direct"), F.when(
        F.col("corrected_query") != "", name_similarity(F.col("corrected_query"), F.col("name"))).alias("fixed"))
    best = likeness.groupBy("query_id", "group_ord").agg(F.max("direct").alias("direct"), F.max("fixed").alias("fixed"))
    chosen = F.coalesce(F.col("left.chosen"), F.lit(False))
    similarity = F.greatest(
        F.coalesce("direct", F.lit(0.0)), F.coalesce(F.col("fixed") * CORRECTED_FACTOR, F.lit(0.0)),
        F.when(chosen, CHOSEN_SIMILARITY).otherwise(0.0))
    return asked.join(best, ["query_id", "group_ord"], "left").withColumn("similarity", similarity).withColumn(
        "score", match_score(F.col("similarity"), F.col("left").isNotNull() & F.col("right").isNotNull(),
                             F.coalesce(F.col("right.sitelinks"), F.lit(0)))).drop("direct", "fixed")


def match_score(similarity: Column, both: Column, sitelinks: Column) -> Column:
    popularity = F.least(F.lit(1.0), F.log1p(sitelinks.cast("double")) / F.log1p(F.lit(float(POPULAR_LINKS))))
    return similarity * SIMILARITY_SHARE + both.cast("int") * BOTH_SHARE + popularity * POPULARITY_SHARE


def with_gap(scored: DataFrame) -> DataFrame:
    """Candidates similar enough, in score order, with the distance to the next one (1.0 when alone)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "group_ord")
    return scored.filter(F.col("similarity") >= MIN_SIMILARITY).withColumns({
        "position": F.row_number().over(order),
        "gap": F.coalesce(F.col("score") - F.lead("score").over(order), F.lit(1.0))})


def decide(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, status) for every query: resolved, ambiguous or not_found."""
    ranked = with_gap(scored)
    asked = normalize_text(F.col("query"))
    cities = F.array_compact(F.array(F.col("left.city"), F.col("right.city")))
    is_city = ranked.groupBy("query_id").agg(F.bool_or(F.exists(cities, lambda c: normalize_text(c) == asked)).alias("city"))
    primary = F.coalesce(F.col("left.name"), F.col("right.name"))
    top = ranked.filter("position = 1").join(is_city, "query_id")
    city_named = F.col("city") & (asked != normalize_text(primary))
    status = (
        F.when(F.col("score") < NOT_FOUND_BELOW, "not_found")
        .when(~city_named & (F.col("similarity") >= RESOLVED_SIMILARITY) & (F.col("score") >= RESOLVED_SCORE)
              & (F.col("gap") >= RESOLVED_GAP), "resolved")
        .otherwise("ambiguous")
    )
    return queries.select("query_id").join(top.select("query_id", status.alias("status")), "query_id", "left").select(
        "query_id", F.coalesce("status", F.lit("not_found")).alias("status"))


def top_candidates(scored: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """The first candidates of every query that found something: none where the best score is too low."""
    first = with_gap(scored).filter(F.col("position") <= limit)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return first.withColumn("_best", best).filter(F.col("_best") >= NOT_FOUND_BELOW).drop("_best")


def to_candidate(ranked: DataFrame) -> DataFrame:
    """Candidate fields: the first registry's data first, the second one's point when it has one."""
    l, r = F.col("left"), F.col("right")
    primary = F.coalesce(l["name"], r["name"])
    names = F.concat(
        F.array_compact(F.array(l["name"], r["name"])), F.coalesce(l["aliases"], F.array().cast("array<string>")),
        F.coalesce(r["aliases"], F.array().cast("array<string>")))
    aliases = F.slice(F.filter(F.array_distinct(names), lambda n: n != primary), 1, MAX_ALIASES)
    registry = F.coalesce(F.nullif(l["ror_id"], F.lit("")), r["ror_id"])
    entity = F.coalesce(F.get(r["wikidata_ids"], F.lit(0)), F.get(l["wikidata_ids"], F.lit(0)))
    point = F.when(r["lat"].isNotNull(), F.struct(r["lat"].alias("lat"), r["lng"].alias("lng"))).otherwise(
        F.struct(F.coalesce(l["lat"], r["lat"]).alias("lat"), F.coalesce(l["lng"], r["lng"]).alias("lng")))
    return ranked.select(
        "query_id", "position",
        F.coalesce(registry, entity, F.replace(normalize_text(primary), F.lit(" "), F.lit("-"))).alias("id"),
        primary.alias("name"), aliases.alias("aliases"), F.coalesce(l["city"], r["city"]).alias("city"),
        F.coalesce(l["country"], r["country"]).alias("country"), point["lat"].alias("lat"), point["lng"].alias("lng"),
        F.coalesce(l["website"], r["website"]).alias("website"), entity.alias("wikidata_id"), registry.alias("ror_id"),
        r["commons_category"].alias("commons_category"),
        F.bround(F.least("score", F.lit(1.0)), 3).alias("match_score"))


def city_center(places: DataFrame, starts: DataFrame, levels: int = 3) -> DataFrame:
    """Walk up from each start place, stopping before the country: the first city-class place with a point, or nothing.

    `places` has place_id, parent_id, is_city, lat, lng; `starts` has profile_id, start_id, country_id.
    """
    node = places.select(
        F.col("place_id").alias("at"), F.col("parent_id").alias("up"), F.col("is_city").alias("city"),
        F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    kind = places.schema["place_id"].dataType.simpleString()
    walk = starts.select("profile_id", "country_id", F.col("start_id").alias("at")).withColumn(
        "found", F.lit(None).cast(f"struct<place_id:{kind},lat:double,lng:double>"))
    for _ in range(levels):
        here = walk.withColumn("at", F.when(F.col("found").isNull() & ~F.coalesce(
            F.col("at") == F.col("country_id"), F.lit(False)), F.col("at")))
        hit = F.when(F.col("city") & F.col("p_lat").isNotNull(), F.struct(
            F.col("at").alias("place_id"), F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng")))
        walk = here.join(node, "at", "left").select(
            "profile_id", "country_id", F.col("up").alias("at"), F.coalesce("found", hit).alias("found"))
    return walk.select("profile_id", F.col("found.place_id").alias("place_id"), F.col("found.lat").alias("lat"),
                       F.col("found.lng").alias("lng"))


def attach_place_labels(rows: DataFrame, labels: DataFrame, lang: str, id_column: str, out: str) -> DataFrame:
    """Label of a place id in the language, else English, else Russian, else any; `labels` has place_id, lang, label."""
    rank = F.when(F.col("lang") == lang, 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "ru", 2).otherwise(3)
    best = labels.groupBy("place_id").agg(F.min(F.struct(rank.alias("rank"), "lang", "label")).alias("b")).select(
        F.col("place_id").alias(id_column), F.col("b.label").alias(out))
    return rows.join(best, id_column, "left")
