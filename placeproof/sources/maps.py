"""Map elements and subject queries to buildings, outlines and subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.functions import geo, rings, rules

# Fixed values.
BUILDING_AMENITIES = ["library", "restaurant", "cafe", "canteen", "food_court"]
BUILDING_LEISURE = ["sports_centre", "stadium", "pitch", "fitness_centre", "swimming_pool"]
OUTER_ROLES = ["outer", "", "perimeter"]
SUBJECT_TYPES = {
    "Q41176": "academic", "Q3914": "academic", "Q11303": "academic", "Q847950": "dorm", "Q7075": "library",
    "Q483110": "sport", "Q31855": "lab",
}
MAX_SUBJECTS = 20
_POINTS = "array<struct<lon:double,lat:double>>"
ELEMENT = f"""type string, id bigint, tags map<string,string>, geometry {_POINTS},
members array<struct<type:string,role:string,geometry:{_POINTS}>>"""
BINDING = ",".join(f"{k} struct<value:string>" for k in ("item", "itemLabel", "coord", "image", "commons", "instance", "direct"))


def _points(geometry: Column) -> Column:
    return F.transform(geometry, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))


def _ring(points: Column) -> Column:
    """Ring of a closed way of at least four points, else null."""
    ring = _points(points)
    closed = (F.size(ring) >= 4) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    return F.when(closed, ring)


def read_elements(payloads: DataFrame) -> DataFrame:
    """Elements (profile_id, seq, payload) with tags and `parts`: the rings they draw.

    A closed way is one ring. The outer ways of a relation are joined at their ends into as many rings as they enclose; its
    inner ways are not cut out. Elements without any ring are left out.
    """
    element = payloads.select("profile_id", "seq", F.from_json("payload", ELEMENT).alias("e"))
    outers = F.filter("e.members", lambda m: (m["type"] == "way") & F.coalesce(m["role"], F.lit("")).isin(OUTER_ROLES))
    ways = F.filter(F.transform(outers, lambda m: _points(m["geometry"])), lambda w: F.size(w) >= 2)
    joined = rings.join_ways(element, F.when(F.col("e.type") == "relation", ways), "joined")
    parts = F.when(F.col("e.type") == "way", F.array_compact(F.array(_ring(F.col("e.geometry"))))).otherwise(F.col("joined"))
    drawn = joined.select(
        "profile_id", "seq", F.col("e.type").alias("kind"), F.col("e.id").alias("element"), F.col("e.tags").alias("tags"), parts.alias("p"))
    # Generated rather than filtered, so that the optimizer doesn't compute the rings once to test and once to return them. The number
    # goes with them: a join by it tests it for null, and that test would parse all payloads once more, before they are dealt out.
    some = drawn.select("profile_id", "seq", "kind", "tags", F.explode(F.when(F.size("p") > 0, F.array(
        F.struct("element", F.col("p").alias("parts"))))).alias("g"))
    return some.select("profile_id", "seq", "kind", F.col("g.element").alias("element"), "tags", F.col("g.parts").alias("parts"))


def number(value: Column) -> Column:
    """`22.5 m` or `22,5` to a number; anything else to null."""
    return F.replace(F.trim(F.regexp_replace(F.trim(value), "m$", "")), F.lit(","), F.lit(".")).try_cast("double")


def normalize_buildings(elements: DataFrame) -> DataFrame:
    """Building rows of map ways, in element order; the outline is rounded to six decimals. A way that crosses itself is none."""
    tags = F.col("tags")
    wanted = (
        F.map_contains_key(tags, "building")
        | F.coalesce(F.element_at(tags, F.lit("amenity")).isin(BUILDING_AMENITIES), F.lit(False))
        | F.coalesce(F.element_at(tags, F.lit("leisure")).isin(BUILDING_LEISURE), F.lit(False)))
    simple = geo.is_simple(geo.edges_of(F.get("parts", F.lit(0))))
    return elements.filter((F.col("kind") == "way") & wanted).filter(simple).select(
        "profile_id", F.col("seq").alias("ord"), F.concat(F.lit("way-"), F.col("element")).alias("building_id"),
        F.coalesce(F.element_at(tags, F.lit("name")), F.lit("")).alias("name"), rules.building_type(tags).alias("type"),
        geo.round_ring(F.get("parts", F.lit(0))).alias("ring"),
        number(F.element_at(tags, F.lit("height"))).alias("height_m"),
        number(F.element_at(tags, F.lit("building:levels"))).cast("int").alias("levels"), F.lit(False).alias("inside_campus"))


def campus_elements(elements: DataFrame) -> DataFrame:
    """Outline candidates for `pick_campus`: all `parts`, and as `ring` the largest; a way that crosses itself is none."""
    tags = F.col("tags")
    names = F.map_values(F.map_filter(tags, lambda k, v: (k == "name") | k.startswith("name:")))
    simple = (F.col("kind") != "way") | geo.is_simple(geo.edges_of(F.get("parts", F.lit(0))))
    return elements.filter(simple).select(
        "profile_id", F.col("element").alias("element_id"), F.element_at(tags, F.lit("amenity")).alias("amenity"),
        F.element_at(tags, F.lit("site")).alias("site"), F.element_at(tags, F.lit("wikidata")).alias("entity_id"),
        names.alias("names"), "parts", geo.outer_ring(F.col("parts")).alias("ring"))


def _last_part(value: Column) -> Column:
    return F.substring_index(value, "/", -1)


def discover_subjects(payloads: DataFrame, boxes: DataFrame) -> DataFrame:
    """Campus items of a subject query (profile_id, seq, payload): direct members or points inside the box.

    Labels and image titles of one item are sets of distinct values; at most twenty items per university in order of
    appearance. `boxes` has profile_id and box.
    """
    row = payloads.select("profile_id", "seq", F.from_json("payload", BINDING).alias("b")).join(
        boxes.select("profile_id", "box"), "profile_id", "left")
    b = F.col("b")
    point = r"Point\((-?[\d.]+) (-?[\d.]+)\)"
    lng = F.regexp_extract(b["coord"]["value"], point, 1).try_cast("double")
    lat = F.regexp_extract(b["coord"]["value"], point, 2).try_cast("double")
    table = F.create_map(*[F.lit(x) for pair in SUBJECT_TYPES.items() for x in pair])
    read = row.select(
        "profile_id", "seq", "box", _last_part(b["item"]["value"]).alias("qid"),
        F.nullif(b["itemLabel"]["value"], F.lit("")).alias("label"), lat.alias("lat"), lng.alias("lng"),
        F.replace(_last_part(b["image"]["value"]), F.lit("_"), F.lit(" ")).alias("image_title"),
        F.nullif(b["commons"]["value"], F.lit("")).alias("commons"),
        F.element_at(table, _last_part(b["instance"]["value"])).alias("building_type"),
        F.coalesce(b["direct"]["value"] == "true", F.lit(False)).alias("direct"))
    kept = read.filter(F.col("qid").startswith("Q") & (
        F.col("direct") | F.coalesce(geo.in_bbox(F.col("box"), F.col("lng"), F.col("lat")), F.lit(False))))
    facts = kept.groupBy("profile_id", "qid").agg(
        F.min("seq").alias("ord"), F.min_by(F.struct("lat", "lng"), "seq").alias("point"),
        F.max_by("commons", F.when(F.col("commons").isNotNull(), F.col("seq"))).alias("category"),
        F.max_by("building_type", F.when(F.col("building_type").isNotNull(), F.col("seq"))).alias("building_type"))
    top = Window.partitionBy("profile_id").orderBy("ord")
    chosen = facts.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= MAX_SUBJECTS).drop("_n")

    def distinct_in_order(column: str, out: str) -> DataFrame:
        first = kept.filter(F.col(column).isNotNull()).groupBy("profile_id", "qid", column).agg(F.min("seq").alias("s"))
        return first.join(chosen.select("profile_id", "qid"), ["profile_id", "qid"], "left_semi").groupBy(
            "profile_id", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", column))), lambda v: v[column]).alias(out))

    none = F.array().cast("array<string>")
    return chosen.join(distinct_in_order("label", "names"), ["profile_id", "qid"], "left").join(
        distinct_in_order("image_title", "image_titles"), ["profile_id", "qid"], "left").select(
        "profile_id", "ord", "qid", F.coalesce("names", none).alias("names"), "category",
        F.coalesce("image_titles", none).alias("image_titles"), F.col("point.lat").alias("lat"), F.col("point.lng").alias("lng"),
        F.coalesce("building_type", F.lit("other")).alias("building_type"))


def filter_subcategories(subs: DataFrame, limit: int = 12) -> DataFrame:
    """Subcategories of places: those named for 2024 or later first, then by folded name; `subs` has profile_id, name."""
    recent = F.col("name").rlike(r"\b20(?:2[4-9]|[3-9]\d)\b")
    order = Window.partitionBy("profile_id").orderBy(F.desc(recent.cast("int")), F.lower("name"), "name")
    return subs.filter(~rules.matches(F.lower("name"), rules.MEDIA_SUBCATEGORY)).withColumn(
        "position", F.row_number().over(order)).filter(F.col("position") <= limit)
