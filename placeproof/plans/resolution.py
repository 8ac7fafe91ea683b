"""Registered queries on registries, candidates, places and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeproof.functions import geo
from placeproof.operators import profile, resolve
from placeproof.plans import views
from placeproof.plans.registry import query
from placeproof.plans.scored_sql import haversine
from placeproof.schemas import REGISTRY_HITS, conform
from placeproof.sources import registries

# Two registries over the parts: a query is a group of eight parts, so a hit has rivals in its own query only.
LEFT = {
    "query_id": "p_partkey // 8" , "ord": "p_partkey % 8", "name": "p_name || ' ' || p_brand || ' university'",
    "city": "'City ' || (p_partkey % 4)", "lat": "37e0 + (p_partkey % 4) * 1e-1", "lng": "127e0 + (p_partkey % 5) * 2e-2",
    "ror_id": "CASE WHEN p_partkey % 3 = 0 THEN 'r' || (p_partkey // 2) END",
    "qid": "CASE WHEN p_partkey % 4 = 1 THEN 'Q' || p_size END", "chosen": "p_partkey % 10 = 0", "links": "0",
}
RIGHT = {
    **LEFT, "ord": "7 - p_partkey % 8", "lat": "37e0 + (p_partkey % 4) * 1e-1 + (p_partkey % 7) * 3e-2",
    "ror_id": "CASE WHEN p_partkey % 6 = 0 THEN 'r' || (p_partkey // 2) END", "chosen": "false", "links": "p_size * 4",
}
SIDES = ", ".join(f"{side} AS ({views.select_sql('part', columns)})" for side, columns in (("l", LEFT), ("r", RIGHT)))
EDGES = f"""WITH {SIDES}, edge AS (SELECT DISTINCT l.query_id, l.ord AS l_ord, r.ord AS r_ord FROM l JOIN r ON l.query_id = r.query_id AND
    (l.ror_id = r.ror_id OR l.qid = r.qid OR (lower(l.name) = lower(r.name) AND
    {haversine('l.lat', 'l.lng', 'r.lat', 'r.lng')} <= 15000)))"""


def _hits(spark, sf_dir, columns):
    exprs = [f"{e.replace('//', 'DIV')} AS {c}" for c, e in columns.items()]
    rows = views.table(spark, sf_dir, "part").selectExpr(*exprs)
    return conform(rows.withColumns({
        "wikidata_ids": F.array_compact(F.array("qid")), "aliases": F.array().cast("array<string>"), "sitelinks": F.col("links"),
        "source": F.lit("registry")}), REGISTRY_HITS)


def _queries(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part")
    return parts.filter(F.col("p_partkey") % 8 == 0).selectExpr(
        "p_partkey DIV 8 AS query_id", "p_name || ' ' || p_brand || ' university' AS query",
        "CAST(NULL AS STRING) AS corrected_query")


def _scored(spark, sf_dir):
    merged = resolve.merge_registries(_hits(spark, sf_dir, LEFT), _hits(spark, sf_dir, RIGHT))
    return resolve.score_candidates(merged, _queries(spark, sf_dir))


@query("same_organisation", EDGES + " SELECT query_id, l_ord, r_ord FROM edge")
def same_organisation(spark, sf_dir):
    return resolve.same_organisation(_hits(spark, sf_dir, LEFT), _hits(spark, sf_dir, RIGHT))


# For merging, a query has two dozen hits a side. In SQL every place of the right side is a step of its own.
WIDE = 24
WIDE_LEFT = {**LEFT, "query_id": f"p_partkey // {WIDE}", "ord": f"p_partkey % {WIDE}"}
WIDE_RIGHT = {**RIGHT, "query_id": f"p_partkey // {WIDE}", "ord": f"{WIDE - 1} - p_partkey % {WIDE}"}


def _merge_sql() -> str:
    sides = ", ".join(f"{side} AS ({views.select_sql('part', columns)})" for side, columns in (("l", WIDE_LEFT), ("r", WIDE_RIGHT)))
    steps = ["t0 AS (SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS r_ord, NULL::BIGINT AS l_ord WHERE false)"]
    for k in range(WIDE):
        steps.append(f"t{k + 1} AS (SELECT * FROM t{k} UNION ALL SELECT e.query_id, e.r_ord, min(e.l_ord) FROM edge e ANTI JOIN t{k} t ON t.query_id = "
                     f"e.query_id AND t.l_ord = e.l_ord WHERE e.r_ord = {k} GROUP BY e.query_id, e.r_ord)")
    edge = EDGES[EDGES.index("edge AS"):]
    return (f"WITH {sides}, {edge}, {', '.join(steps)} SELECT coalesce(l.query_id, r.query_id) AS query_id, coalesce(l.ord, r.ord + {resolve.AFTER_LEFT}) AS "
            f"group_ord, l.name AS l_name, r.name AS r_name FROM l LEFT JOIN t{WIDE} t ON t.query_id = l.query_id AND t.l_ord = l.ord FULL JOIN r ON "
            "r.query_id = t.query_id AND r.ord = t.r_ord")


@query("merge_registries", _merge_sql())
def merge_registries(spark, sf_dir):
    merged = resolve.merge_registries(_hits(spark, sf_dir, WIDE_LEFT), _hits(spark, sf_dir, WIDE_RIGHT))
    return merged.select("query_id", "group_ord", F.col("left.name").alias("l_name"), F.col("right.name").alias("r_name"))


@query("resolve_status")
def resolve_status(spark, sf_dir):
    return resolve.decide(_scored(spark, sf_dir), _queries(spark, sf_dir))


@query("top_candidates")
def top_candidates(spark, sf_dir):
    return resolve.to_candidate(resolve.top_candidates(_scored(spark, sf_dir))).select(
        "query_id", "position", "id", "name", "city", "lat", "lng", "match_score")


LIKENESS = "(p_size * 7 % 41) / 4e1"
GIVEN = f"""given AS (SELECT p_partkey // 8 AS query_id, p_partkey % 8 AS group_ord, p_name AS name, {LIKENESS} AS similarity,
    0.55e0 * {LIKENESS} + CASE WHEN p_partkey % 2 = 0 THEN 0.15e0 ELSE 0e0 END + 0.3e0 * least(1e0, ln(1 + p_size * 4) / ln(151)) AS score
    FROM part), kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, group_ord) AS position,
    coalesce(score - lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, group_ord), 1e0) AS gap FROM given
    WHERE similarity >= 0.6e0)"""


def _given(spark, sf_dir):
    """Candidates with a given likeness, so that scores and decisions can be checked without the name ratio."""
    part = views.table(spark, sf_dir, "part")
    similarity = F.expr(LIKENESS)
    score = resolve.match_score(similarity, F.col("p_partkey") % 2 == 0, F.col("p_size") * 4)
    hit = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("red "), F.substring_index("p_name", " ", -1)).alias("city"))
    return part.select(
        F.expr("p_partkey DIV 8").alias("query_id"), (F.col("p_partkey") % 8).alias("group_ord"), F.col("p_name").alias("name"),
        similarity.alias("similarity"), score.alias("score"), hit.alias("left"), F.lit(None).cast(
            "struct<name:string,city:string>").alias("right"), F.lit("red bolt").alias("query"))


@query("match_score", f"WITH {GIVEN} SELECT query_id, group_ord, round(score, 6) AS score FROM given")
def match_score(spark, sf_dir):
    return _given(spark, sf_dir).select("query_id", "group_ord", F.round("score", 6).alias("score"))


@query("resolve_gap", f"WITH {GIVEN} SELECT query_id, group_ord, position, round(gap, 6) AS gap FROM kept")
def resolve_gap(spark, sf_dir):
    return resolve.with_gap(_given(spark, sf_dir)).select("query_id", "group_ord", "position", F.round("gap", 6).alias("gap"))


@query("decide_status", f"WITH {GIVEN}" + """, c AS (SELECT query_id, bool_or(string_split(name, ' ')[-1] = 'bolt') AS city FROM kept GROUP BY
    query_id) SELECT q.query_id, CASE WHEN k.score IS NULL OR k.score < 0.55e0 THEN 'not_found' WHEN NOT (c.city AND k.name <> 'red bolt') AND
    k.similarity >= 0.9e0 AND k.score >= 0.7e0 AND k.gap >= 0.1e0 THEN 'resolved' ELSE 'ambiguous' END AS status FROM (SELECT DISTINCT
    p_partkey // 8 AS query_id FROM part) q LEFT JOIN kept k ON k.query_id = q.query_id AND k.position = 1 LEFT JOIN c ON c.query_id =
    q.query_id""")
def decide_status(spark, sf_dir):
    given = _given(spark, sf_dir)
    return resolve.decide(given, given.select("query_id").distinct())


@query("best_candidates", f"""WITH {GIVEN} SELECT query_id, name, position FROM kept WHERE position <= 5 AND query_id IN
    (SELECT query_id FROM kept GROUP BY query_id HAVING max(score) >= 0.55e0)""")
def best_candidates(spark, sf_dir):
    return resolve.top_candidates(_given(spark, sf_dir)).select("query_id", "name", "position")


# ---- places ----

# Customers form a tree: each lies in the one of a third of its number; every seventh is a city, every fifth has no point.
@query("city_center", """WITH node AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 3 THEN c_custkey // 3 END AS up, c_custkey % 7 = 0 AS
    city, c_custkey % 5 <> 0 AS point FROM customer), s AS (SELECT s_suppkey AS profile_id, s_suppkey * 13 % (SELECT count(*) FROM customer)
    AS start_at, s_nationkey AS country FROM supplier), a AS (SELECT s.*, n.up AS up1, n.city AND n.point AS hit1 FROM s LEFT JOIN node n ON n.id =
    s.start_at), b AS (SELECT a.*, n.up AS up2, n.city AND n.point AS hit2 FROM a LEFT JOIN node n ON n.id = a.up1), c AS (SELECT b.*, n.city AND
    n.point AS hit3 FROM b LEFT JOIN node n ON n.id = b.up2) SELECT profile_id, CASE WHEN start_at = country THEN NULL WHEN hit1 THEN start_at WHEN up1 =
    country THEN NULL WHEN hit2 THEN up1 WHEN up2 = country THEN NULL WHEN hit3 THEN up2 END AS place_id FROM c""")
def city_center(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer")
    count = customers.agg(F.count("*").alias("n")).scalar()
    places = customers.selectExpr(
        "c_custkey AS place_id", "CASE WHEN c_custkey >= 3 THEN c_custkey DIV 3 END AS parent_id", "c_custkey % 7 = 0 AS is_city",
        "CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 1e-2 END AS lat", "CASE WHEN c_custkey % 5 <> 0 THEN 127e0 END AS lng")
    starts = views.table(spark, sf_dir, "supplier").withColumn("n", count).selectExpr(
        "s_suppkey AS profile_id", "s_suppkey * 13 % n AS start_id", "CAST(s_nationkey AS BIGINT) AS country_id")
    return resolve.city_center(places, starts).select("profile_id", "place_id")


@query("attach_place_labels", """WITH lab AS (SELECT c_nationkey AS place_id, CASE c_custkey % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' WHEN 2 THEN
    'ko' ELSE 'kk' END AS lang, c_name AS label FROM customer), best AS (SELECT *, row_number() OVER
    (PARTITION BY place_id ORDER BY CASE lang WHEN 'ko' THEN 0 WHEN 'en' THEN 1 WHEN 'ru' THEN 2 ELSE 3 END, lang, label) AS n FROM lab)
    SELECT s_suppkey, label AS place FROM supplier LEFT JOIN best ON place_id = s_nationkey AND n = 1""")
def attach_place_labels(spark, sf_dir):
    labels = views.table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS place_id", "CASE c_custkey % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' WHEN 2 THEN 'ko' ELSE 'kk' END AS lang",
        "c_name AS label")
    rows = views.table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "city_id")
    return resolve.attach_place_labels(rows, labels, "ko", "city_id", "place").select("s_suppkey", "place")


# ---- registry payloads ----

def _organisations(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    name = F.struct(F.col("p_name").alias("value"), F.array(F.when(F.col("p_partkey") % 9 != 8, "ror_display").otherwise("label")).alias("types"))
    other = F.struct(F.col("p_brand").alias("value"), F.array(F.lit("acronym")).alias("types"))
    payload = F.to_json(F.struct(
        F.concat(F.lit("https://registry.example.org/r"), key).alias("id"),
        F.array(F.when(F.col("p_partkey") % 4 == 3, "company").otherwise("education")).alias("types"), F.array(other, name).alias("names"),
        F.array(F.struct(F.struct(F.col("p_type").alias("name"), F.lit("Land").alias("country_name"), (F.col("p_size") * 1e-1).alias("lat"),
                                  F.lit(1.5).alias("lng")).alias("geonames_details"))).alias("locations"),
        F.array(F.struct(F.lit("wikipedia").alias("type"), F.lit("w").alias("value")),
                F.struct(F.lit("website").alias("type"), F.concat(F.lit("https://u"), key).alias("value"))).alias("links"),
        F.array(F.struct(F.lit("wikidata").alias("type"), F.array(F.concat(F.lit("Q"), key)).alias("all"))).alias("external_ids")))
    return part.select(F.expr("p_partkey DIV 16").alias("query_id"), (F.col("p_partkey") % 16).alias("ord"), payload.alias("payload"),
                       F.lit(False).alias("chosen"))


@query("normalize_registry", """SELECT query_id, ror_id, name, alias, city, website, qid, round(lat, 6) AS lat FROM (SELECT p_partkey // 16 AS
    query_id, 'r' || p_partkey AS ror_id, p_name AS name, p_brand AS alias, p_type AS city, 'https://u' || p_partkey AS website, 'Q' ||
    p_partkey AS qid, p_size * 1e-1 AS lat, row_number() OVER (PARTITION BY p_partkey // 16 ORDER BY p_partkey) AS n FROM part WHERE
    p_partkey % 4 <> 3 AND p_partkey % 9 <> 8) WHERE n <= 10""")
def normalize_registry(spark, sf_dir):
    hits = registries.normalize_registry(_organisations(spark, sf_dir))
    return hits.select("query_id", "ror_id", "name", F.array_join("aliases", "|").alias("alias"), "city", "website",
                       F.array_join("wikidata_ids", "|").alias("qid"), F.round("lat", 6).alias("lat"))


def _entities(spark, sf_dir):
    """Entity records of the customers, as JSON text."""
    c = views.table(spark, sf_dir, "customer")

    def value(v):
        return f"named_struct('mainsnak', named_struct('datavalue', named_struct('value', {v})))"

    labels = """map_from_arrays(CASE c_custkey % 3 WHEN 0 THEN array('ko', 'en') WHEN 1 THEN array('ru', 'kk') ELSE array('kk', 'fr') END,
        array(named_struct('value', c_name || ' A'), named_struct('value', c_name || ' B')))"""
    payload = f"""to_json(named_struct('id', 'Q' || c_custkey, 'missing', CASE WHEN c_custkey % 11 = 10 THEN '' END, 'labels', {labels},
        'aliases', map('en', array(named_struct('value', c_mktsegment), named_struct('value', c_mktsegment))),
        'descriptions', map('en', named_struct('value', CASE WHEN c_custkey % 5 = 4 THEN 'a river' ELSE 'public University' END)),
        'claims', map('P856', array({value("CAST(NULL AS STRING)")}, {value("'https://w' || c_custkey")}),
            'P625', array({value("to_json(named_struct('latitude', c_acctbal / 1e2, 'longitude', 1e0))")}),
            'P131', array({value("to_json(named_struct('id', 'P' || c_nationkey))")})),
        'sitelinks', map('enwiki', named_struct('title', c_name), 'dewiki', named_struct('title', c_name))))"""
    return c.selectExpr("c_custkey DIV 10 AS query_id", "c_custkey % 10 AS ord", f"{payload} AS payload")


ENTITY_NAMES = """CASE c_custkey % 3 WHEN 0 THEN c_name || ' B' ELSE c_name || ' A' END AS name, CASE c_custkey % 3 WHEN 0 THEN c_name || ' A'
    ELSE c_name || ' B' END AS other"""


@query("normalize_entities", f"""SELECT 'Q' || c_custkey AS qid, name, c_mktsegment || '|' || other AS aliases, 'P' || c_nationkey AS city_id,
    'https://w' || c_custkey AS website, round(c_acctbal / 1e2, 6) AS lat, 2 AS sitelinks FROM (SELECT *, {ENTITY_NAMES} FROM customer WHERE
    c_custkey % 5 <> 4)""")
def normalize_entities(spark, sf_dir):
    hits = registries.normalize_entities(_entities(spark, sf_dir), "en")
    return hits.select(F.get("wikidata_ids", F.lit(0)).alias("qid"), "name", F.array_join("aliases", "|").alias("aliases"), "city_id",
                       "website", F.round("lat", 6).alias("lat"), "sitelinks")


@query("university_records", """SELECT 'Q' || c_custkey AS wikidata_id, CASE c_custkey % 3 WHEN 0 THEN c_name || ' A' ELSE c_name || ' A' END
    AS name, c_name || ' A|' || c_name || ' B|' || c_mktsegment AS names, c_name AS title, 'P' || c_nationkey AS city_id FROM customer WHERE
    c_custkey % 11 <> 10""")
def university_records(spark, sf_dir):
    rows = registries.university_records(_entities(spark, sf_dir), "ko")
    return rows.select("wikidata_id", "name", F.array_join("names", "|").alias("names"),
                       F.element_at("wikipedia_titles", F.lit("en")).alias("title"), "city_id")


# ---- profile rows ----

def _universities(spark, sf_dir):
    rows = views.campus(spark, sf_dir)
    name = F.get("names", F.lit(0))
    return rows.select(
        "profile_id", name.alias("name"), F.concat(name, F.lit(" EN")).alias("name_en"),
        F.array(name, F.concat(name, F.lit(" x")), F.concat(name, F.lit(" y")), F.concat(name, F.lit(" x"))).alias("names"),
        F.create_map(F.lit("ko"), F.concat(name, F.lit(" KO")), F.lit("fr"), F.concat(name, F.lit(" y"))).alias("names_by_language"),
        "lat", "lng", "ring", F.when(F.col("profile_id") % 2 == 0, "Town").alias("city"), F.lit("Land").alias("country"),
        F.concat(F.lit("https://u"), F.col("profile_id").cast("string")).alias("website"))


@query("build_search_plan", f"WITH {views.with_views('campus')} " + """SELECT profile_id, name || ' EN|' || name || '|' || name || ' KO|' || name
    || ' x|' || name || ' y' AS names, CASE WHEN outlined THEN round(lng - 6e-3, 6) END AS west FROM campus""")
def build_search_plan(spark, sf_dir):
    plan = profile.build_search_plan(_universities(spark, sf_dir))
    return plan.select("profile_id", F.array_join("names", "|").alias("names"), F.round("box.w", 6).alias("west"))


@query("search_subjects", f"WITH {views.with_views('campus', 'bldg')} " + """SELECT profile_id, 'university' AS kind, name AS subject, NULL AS
    building_type FROM campus UNION ALL SELECT profile_id, 'building', name, type FROM bldg WHERE inside_campus AND name <> '' UNION ALL SELECT
    s_nationkey, 'building', s_name, 'other' FROM supplier UNION ALL SELECT profile_id, 'city', 'Town', NULL FROM campus WHERE profile_id % 3 =
    0""")
def search_subjects(spark, sf_dir):
    universities = _universities(spark, sf_dir)
    discovered = views.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("profile_id"), F.col("s_suppkey").alias("ord"), F.array("s_name").alias("names"),
        F.lit("other").alias("building_type"))
    centers = universities.filter("profile_id % 3 = 0").select("profile_id", F.lit("Town").alias("center_name"))
    subjects = profile.search_subjects(universities, views.buildings(spark, sf_dir), discovered, centers)
    return subjects.select("profile_id", "kind", "subject", "building_type")


@query("attach_subject", f"WITH {views.with_views('img')} " + """, s AS (SELECT s_nationkey AS profile_id, CASE WHEN s_suppkey % 2 = 0 THEN
    'NATION ' || s_nationkey ELSE 'Library of NATION ' || s_nationkey END AS category, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP
    BY 1, 2) SELECT i.id, s.name AS subject_name FROM img i LEFT JOIN s ON s.profile_id = i.profile_id AND s.category = i.matched_category""")
def attach_subject(spark, sf_dir):
    key = F.col("s_nationkey").cast("string")
    subjects = views.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("profile_id"), F.col("s_suppkey").alias("ord"),
        F.concat(F.when(F.col("s_suppkey") % 2 == 0, "NATION ").otherwise("Library of NATION "), key).alias("category"),
        F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("subject_id"), F.col("s_name").alias("subject_name"),
        F.lit("building").alias("subject_kind"), F.lit("other").alias("subject_building_type"))
    return profile.attach_subject(views.images(spark, sf_dir), subjects).select("id", "subject_name")


CENTERS = "CASE WHEN profile_id % 3 = 0 THEN 'Town ' || profile_id END"


def _profiles(spark, sf_dir):
    universities = _universities(spark, sf_dir)
    shapes = universities.filter("ring IS NOT NULL").select("profile_id", F.bround(geo.area_km2(geo.edges_of(F.col("ring"))), 2).alias("area_km2"))
    centers = universities.filter("profile_id % 3 = 0").select(
        "profile_id", F.concat(F.lit("Town "), F.col("profile_id").cast("string")).alias("center_name"),
        (F.col("lat") + 2e-2).alias("center_lat"), F.col("lng").alias("center_lng"))
    routes = universities.select("profile_id", (F.col("profile_id") * 1.25 + 1).alias("road_km"), (F.col("profile_id") * 97.0).alias("drive_s"))
    return profile.university_profile(universities, shapes, centers, routes)


PROFILE_SQL = f"""prof AS (SELECT *, {CENTERS} AS center, CASE WHEN profile_id % 3 = 0 THEN round_even({haversine('lat', 'lng', '(lat + 2e-2)', 'lng')}
    / 1000, 1) END AS center_km, CASE WHEN profile_id % 3 = 0 THEN round_even(profile_id * 1.25e0 + 1, 1) END AS road_km, CASE WHEN profile_id %
    3 = 0 THEN greatest(1, CAST(round_even(profile_id * 97e0 / 60, 0) AS INT)) END AS drive_min, CASE WHEN profile_id % 3 = 0 THEN greatest(1,
    CAST(round_even((profile_id * 1.25e0 + 1) / 4.8e0 * 60, 0) AS INT)) END AS walk_min FROM campus)"""


@query("university_profile", f"WITH {views.with_views('campus')}, {PROFILE_SQL} " + """SELECT profile_id, name || ' x|' || name || ' y|' || name
    || ' x' AS aliases, coalesce(center, CASE WHEN profile_id % 2 = 0 THEN 'Town' END) AS city, center_km, road_km, drive_min, walk_min FROM
    prof""")
def university_profile(spark, sf_dir):
    return _profiles(spark, sf_dir).select(
        "profile_id", F.array_join("aliases", "|").alias("aliases"), "city", "center_km", "road_km", "drive_min", "walk_min")


@query("profile_facts", f"WITH {views.with_views('campus', 'img')}, {PROFILE_SQL}" + """, n AS (SELECT profile_id, count_if(doc % 2 = 0) AS a,
    count_if(doc % 2 = 1) AS b FROM (SELECT profile_id, seq AS doc FROM img WHERE seq % 3 <> 0) GROUP BY profile_id), f AS (SELECT profile_id,
    unnest([1, 2, 3, 5]) AS k, name, center, center_km, a, b FROM prof JOIN n USING (profile_id)), t AS (SELECT profile_id, k, CASE k WHEN 1
    THEN name || '; city: ' || coalesce(center, CASE WHEN profile_id % 2 = 0 THEN 'Town' END, 'unknown') || '; country: Land; website: https://u'
    || profile_id WHEN 2 THEN CASE WHEN profile_id % 4 = 0 THEN 'About ' || name END WHEN 5 THEN 'Reliable photos: campus ' || a ||
    ', dorms ' || b || ', classrooms 0, libraries 0, city 0; from 2024 on 0' END AS fact FROM f WHERE k <> 3) SELECT profile_id,
    row_number() OVER (PARTITION BY profile_id ORDER BY k) AS no, fact FROM t WHERE fact IS NOT NULL""")
def profile_facts(spark, sf_dir):
    photos = views.images(spark, sf_dir).select(
        "profile_id", F.when(F.col("seq") % 2 == 0, "campus").otherwise("dorms").alias("category"), F.lit("older").alias("freshness"),
        F.when(F.col("seq") % 3 != 0, "likely").otherwise("unconfirmed").alias("tier"))
    none = F.lit(None).cast("double")
    profiles = _profiles(spark, sf_dir).withColumns({"center_km": none, "area_km2": none}).withColumn("summary", F.when(
        F.col("profile_id") % 4 == 0, F.concat(F.lit("About "), F.col("name"))))
    return profile.profile_facts(profiles, photos).select("profile_id", F.col("no").cast("bigint").alias("no"), "fact")


@query("summary_sources", f"WITH {views.with_views('img', 'campus')} " + """, t AS (SELECT profile_id, 0 AS part, 0 AS seq, 'About ' || name AS
    text FROM campus WHERE profile_id % 2 = 0 UNION ALL SELECT profile_id, 1, min(seq), description FROM img WHERE source = 'official_site' AND
    trim(description) <> '' GROUP BY profile_id, description) SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY part, seq)
    AS no, md5(text) AS digest FROM t""")
def summary_sources(spark, sf_dir):
    extracts = views.campus(spark, sf_dir).filter("profile_id % 2 = 0").select(
        "profile_id", F.concat(F.lit("About "), F.get("names", F.lit(0))).alias("text"))
    texts = profile.summary_sources(extracts, views.images(spark, sf_dir).select("profile_id", "seq", "source", "description"))
    return texts.select("profile_id", "no", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("extractive_summary", """SELECT doc_id % 25 AS profile_id, coalesce(md5(arg_min(text, doc_id) FILTER (doc_id % 3 = 0)), md5('')) AS digest,
    CASE WHEN count_if(doc_id % 3 = 0) > 0 THEN 1 END AS citation FROM documents GROUP BY 1""")
def extractive_summary(spark, sf_dir):
    texts = views.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 25).alias("profile_id"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 3 == 0).alias("is_extract"), "text")
    return profile.extractive_summary(texts).select(
        "profile_id", F.md5(F.col("text").cast("binary")).alias("digest"), "citation")
