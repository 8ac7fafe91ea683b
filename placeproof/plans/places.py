"""Registered queries on points, rings, boxes and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeproof.functions import geo, text
from placeproof.operators import reports, spatial
from placeproof.plans import views
from placeproof.plans.registry import query
from placeproof.plans.scored_sql import haversine, located

RINGS = """ring AS (SELECT c.profile_id, c.lat, c.lng, e.i, c.lng + e.ax / 1e3 AS x1, c.lat + e.ay / 1e3 AS y1, c.lng + e.zx / 1e3 AS x2,
    c.lat + e.zy / 1e3 AS y2 FROM campus c, edges e WHERE c.outlined)"""


def _campus_views(rest: str) -> str:
    return f"WITH {views.with_views('img', 'campus', 'bldg', 'edges')}, {RINGS} {rest}"


def _ringed(spark, sf_dir):
    return views.campus(spark, sf_dir).filter(F.col("ring").isNotNull())


@query("locate_on_campus", located("""SELECT i.id, geo_key, CAST(geo_weight AS BIGINT) AS weight, on_campus, round(geo_meters, 3) AS meters
    FROM geo JOIN img i USING (seq)"""))
def locate_on_campus(spark, sf_dir):
    placed = spatial.locate_on_campus(views.images(spark, sf_dir).select("profile_id", "id", "lat", "lng"), views.campus(spark, sf_dir))
    return placed.select("id", F.col("geo.key").alias("geo_key"), F.col("geo.weight").cast("bigint").alias("weight"),
                         F.col("geo.on_campus").alias("on_campus"), F.round("geo.meters", 3).alias("meters"))


@query("building_at", located("SELECT i.id, h.ord FROM hit h JOIN img i USING (seq)"))
def building_at(spark, sf_dir):
    images = views.images(spark, sf_dir).select("profile_id", "seq", "lat", "lng")
    return spatial.building_at(images, views.buildings(spark, sf_dir)).select(
        F.concat(F.lit("img-"), F.col("seq").cast("string")).alias("id"), F.col("building.ord").alias("ord"))


@query("photo_pins", located("""SELECT i.id, b.building_id, i.lat, i.lng FROM img i LEFT JOIN hit h USING (seq) LEFT JOIN bldg b ON
    b.ord = h.ord WHERE i.lat IS NOT NULL"""))
def photo_pins(spark, sf_dir):
    images = views.images(spark, sf_dir).select("profile_id", "seq", "id", "lat", "lng")
    pins, _ = spatial.link_photos(images, views.buildings(spark, sf_dir))
    return pins.select("id", "building_id", "lat", "lng")


@query("building_photos", located("""SELECT b.building_id, 'img-' || h.seq AS photo_id FROM bldg b LEFT JOIN hit h ON h.ord = b.ord"""))
def building_photos(spark, sf_dir):
    images = views.images(spark, sf_dir).select("profile_id", "seq", "id", "lat", "lng")
    buildings = views.buildings(spark, sf_dir)
    _, links = spatial.link_photos(images, buildings)
    return spatial.building_photos(buildings, links).select("building_id", "photo_id")


@query("buildings_near_campus", _campus_views(""", spot AS (SELECT b.building_id, b.cx, b.cy, r.*, greatest(0e0, least(1e0, ((cx - x1) *
    (x2 - x1) + (cy - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM bldg b JOIN ring r ON r.profile_id = b.profile_id),
    f AS (SELECT building_id, sum(CASE WHEN (y1 > cy) <> (y2 > cy) AND cx < (x2 - x1) * (cy - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END)
    % 2 = 1 AS inside, min(pow(cx - x1 - t * (x2 - x1), 2) + pow(cy - y1 - t * (y2 - y1), 2)) AS d2 FROM spot GROUP BY building_id)
    SELECT building_id, inside AS inside_campus FROM f WHERE inside OR sqrt(d2) < 0.1e0 / 111.32e0 UNION ALL
    SELECT building_id, false FROM bldg b JOIN campus c ON c.profile_id = b.profile_id AND NOT c.outlined"""))
def buildings_near_campus(spark, sf_dir):
    return spatial.buildings_near_campus(views.buildings(spark, sf_dir), views.campus(spark, sf_dir)).select(
        "building_id", "inside_campus")


@query("ring_metrics", _campus_views(""", shifted AS (SELECT *, (x1 - lng) * (y2 - lat) - (x2 - lng) * (y1 - lat) AS cross_z FROM ring),
    m AS (SELECT profile_id, min(x1) AS w, min(y1) AS s, max(x1) AS e, max(y1) AS n, abs(sum(cross_z)) / 2 AS area,
    any_value(lat) + sum((y1 + y2 - 2 * lat) * cross_z) / (3 * sum(cross_z)) AS center_lat FROM shifted GROUP BY profile_id)
    SELECT profile_id, round(w, 6) AS w, round(s, 6) AS s, round(e, 6) AS e, round(n, 6) AS n, round(center_lat, 6) AS center_lat,
    round(area * 111.32e0 * 111.32e0 * cos(radians(center_lat)), 6) AS area_km2 FROM m"""))
def ring_metrics(spark, sf_dir):
    done = spatial.ring_metrics(_ringed(spark, sf_dir))
    return done.select("profile_id", *[F.round(f"box.{c}", 6).alias(c) for c in "wsen"],
                       F.round("center.y", 6).alias("center_lat"), F.round("area_km2", 6).alias("area_km2"))


@query("haversine", f"WITH {views.with_views('img', 'campus')} SELECT i.id, round({haversine('c.lat', 'c.lng', 'i.lat', 'i.lng')}, 3) "
                    "AS meters FROM img i JOIN campus c USING (profile_id)")
def haversine_query(spark, sf_dir):
    centers = views.campus(spark, sf_dir).select("profile_id", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    rows = views.images(spark, sf_dir).select("profile_id", "id", "lat", "lng").join(centers, "profile_id")
    return rows.select("id", F.round(geo.haversine_m(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng")), 3).alias("meters"))


BOX = "lng - hw AS w, lat - hh AS s, lng + hw AS e, lat + hh AS n"
SIZED = f"sized AS (SELECT profile_id, lat, lng, {BOX} FROM (SELECT *, (profile_id + 1) * 1e-2 AS hw, (profile_id + 1) * 5e-3 AS hh FROM campus))"


@query("bbox_family", f"WITH {views.with_views('campus')}, {SIZED}, " + """k AS (SELECT *, sqrt(1e-2 / ((e - w) * (n - s))) * 0.99e0 AS k FROM
    sized) SELECT profile_id, round(lng - 0.6e0 / (111.32e0 * cos(radians(lat))), 6) AS point_w, round(lat + 0.6e0 / 111.32e0, 6) AS point_n,
    round(w - 0.25e0 / (111.32e0 * cos(radians((s + n) / 2))), 6) AS padded_w, round(s - 0.25e0 / 111.32e0, 6) AS padded_s,
    round(CASE WHEN (e - w) * (n - s) <= 1e-2 THEN w ELSE (w + e) / 2 - (e - w) / 2 * k END, 6) AS clamped_w,
    round(CASE WHEN (e - w) * (n - s) <= 1e-2 THEN n ELSE (s + n) / 2 + (n - s) / 2 * k END, 6) AS clamped_n,
    greatest(1000, CAST(floor(""" + haversine("s", "w", "n", "e") + """ / 2) AS INT)) AS radius FROM k""")
def bbox_family(spark, sf_dir):
    hw, hh = (F.col("profile_id") + 1) * 1e-2, (F.col("profile_id") + 1) * 5e-3
    rows = views.campus(spark, sf_dir).withColumn("box", geo.bbox(
        F.col("lng") - hw, F.col("lat") - hh, F.col("lng") + hw, F.col("lat") + hh))
    point, padded = geo.point_bbox(F.col("lat"), F.col("lng"), 0.6), geo.padded_bbox(F.col("box"))
    clamped = geo.clamp_bbox(F.col("box"))
    return rows.select(
        "profile_id", F.round(point["w"], 6).alias("point_w"), F.round(point["n"], 6).alias("point_n"),
        F.round(padded["w"], 6).alias("padded_w"), F.round(padded["s"], 6).alias("padded_s"),
        F.round(clamped["w"], 6).alias("clamped_w"), F.round(clamped["n"], 6).alias("clamped_n"),
        geo.campus_radius_m(F.col("box")).alias("radius"))


@query("search_centers", _campus_views(""", b AS (SELECT profile_id, min(x1) AS w, min(y1) AS s, max(x1) AS e, max(y1) AS n FROM ring GROUP BY
    profile_id), m AS (SELECT *, (n - s) * 111320e0 AS hm, (e - w) * 111320e0 * cos(radians((s + n) / 2)) AS wm FROM b), g AS (SELECT *,
    least(3, greatest(1, CAST(ceil(wm / 1500) AS INT))) AS nx, least(3, greatest(1, CAST(ceil(hm / 1500) AS INT))) AS ny FROM m)
    SELECT profile_id, round(s + (iy + 0.5e0) * (n - s) / ny, 6) AS lat, round(w + (ix + 0.5e0) * (e - w) / nx, 6) AS lng, greatest(500,
    least(10000, CAST(ceil(greatest(wm / nx, hm / ny) * 0.8e0) AS INT))) AS radius_m FROM g, range(3) a(ix), range(3) c(iy) WHERE ix < nx AND
    iy < ny UNION ALL SELECT profile_id, round(lat, 6), round(lng, 6), 1000 FROM campus WHERE NOT outlined"""))
def search_centers(spark, sf_dir):
    rows = views.campus(spark, sf_dir)
    centers = rows.select("profile_id", F.explode(geo.search_centers(F.col("ring"), F.col("lat"), F.col("lng"))).alias("c"))
    return centers.select("profile_id", F.round("c.lat", 6).alias("lat"), F.round("c.lng", 6).alias("lng"),
                          F.col("c.radius_m").alias("radius_m"))


@query("within_bbox", _campus_views(""", b AS (SELECT profile_id, min(x1) AS w, min(y1) AS s, max(x1) AS e, max(y1) AS n FROM ring GROUP BY
    profile_id) SELECT i.id, b.profile_id FROM img i JOIN b ON i.lng BETWEEN w - 0.25e0 / (111.32e0 * cos(radians((s + n) / 2))) AND e +
    0.25e0 / (111.32e0 * cos(radians((s + n) / 2))) AND i.lat BETWEEN s - 0.25e0 / 111.32e0 AND n + 0.25e0 / 111.32e0"""))
def within_bbox(spark, sf_dir):
    points = views.images(spark, sf_dir).select("id", "lat", "lng")
    boxes = _ringed(spark, sf_dir).select("profile_id", geo.bbox_of(F.col("ring")).alias("box"))
    return spatial.within_bbox(points, boxes).select("id", "profile_id")


@query("within_wide_bbox", f"WITH {views.with_views('img', 'campus')}, b AS (SELECT profile_id, lng - hw AS w, lat - hw / 2 AS s, lng + hw AS e, lat + "
                           "hw / 2 AS n FROM (SELECT *, 1e-2 * pow(2, profile_id % 13) AS hw FROM campus)) SELECT i.id, b.profile_id FROM img i "
                           "JOIN b ON i.lng BETWEEN w AND e AND i.lat BETWEEN s AND n")
def within_wide_bbox(spark, sf_dir):
    """Boxes from the size of a campus to that of a continent."""
    half = 1e-2 * F.pow(F.lit(2.0), F.col("profile_id") % 13)
    boxes = views.campus(spark, sf_dir).select("profile_id", geo.bbox(
        F.col("lng") - half, F.col("lat") - half / 2, F.col("lng") + half, F.col("lat") + half / 2).alias("box"))
    return spatial.within_bbox(views.images(spark, sf_dir).select("id", "lat", "lng"), boxes, pad_m=0.0).select("id", "profile_id")


@query("within_radius", f"WITH {views.with_views('img', 'campus')} SELECT DISTINCT i.id, c.profile_id FROM img i JOIN campus c ON "
                        f"{haversine('c.lat', 'c.lng', 'i.lat', 'i.lng')} <= least(10000, 10 + c.profile_id * 600)")
def within_radius(spark, sf_dir):
    points = views.images(spark, sf_dir).select("id", "lat", "lng")
    circles = views.campus(spark, sf_dir).select("profile_id", "lat", "lng", (10 + F.col("profile_id") * 600).alias("radius_m"))
    return spatial.within_radius(points, circles).select("id", "profile_id")


@query("headings", f"WITH {views.with_views('img', 'campus')} " + """SELECT id, round_even(((seq * 1.7e0) % 360 + 360) % 360, 1) AS heading,
    round(degrees(atan2(-sin(atan2(c.lat - i.lat, c.lng - i.lng)), cos(atan2(c.lat - i.lat, c.lng - i.lng)))), 4) AS bearing FROM img i JOIN
    campus c USING (profile_id)""")
def headings(spark, sf_dir):
    centers = views.campus(spark, sf_dir).select("profile_id", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    rows = views.images(spark, sf_dir).select("profile_id", "id", "seq", "lat", "lng").join(centers, "profile_id")
    return rows.select("id", geo.heading(F.col("seq") * 1.7).alias("heading"), F.round(geo.bearing_to_center(
        F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")), 4).alias("bearing"))


@query("outer_ring", f"WITH {views.with_views('bldg')} " + """SELECT building_id, CASE WHEN 4e0 * hw * hh >= 4e-8 THEN
    round_even(cx - hw, 6) ELSE round_even(cx - 1e-4, 6) END AS first_x FROM bldg""")
def outer_ring(spark, sf_dir):
    rows = views.derived(spark, sf_dir, "part", views.BUILDING)
    cx, cy, hw, hh = (F.col(c) for c in ("cx", "cy", "hw", "hh"))
    small = views.box_ring(cx - 1e-4, cy - 1e-4, cx + 1e-4, cy + 1e-4)
    parts = F.array(small, views.box_ring(cx - hw, cy - hh, cx + hw, cy + hh))
    return rows.select("building_id", geo.outer_ring(parts)[0]["x"].alias("first_x"))


@query("cluster_pins", f"WITH {views.with_views('img', 'campus')} " + """, b AS (SELECT profile_id, lng - 0.011e0 AS w, lng + 0.011e0 AS e,
    lat - 0.011e0 AS s, lat + 0.011e0 AS n FROM campus), p AS (SELECT i.profile_id, i.id, i.seq, (i.lng - w) / (e - w) * 100 AS x, (n - i.lat)
    / (n - s) * 100 AS y FROM img i JOIN b USING (profile_id) WHERE i.lat IS NOT NULL) SELECT profile_id, CAST(floor(x / 13 + 0.5e0) AS BIGINT)
    AS cell_x, CAST(floor(y / 13 + 0.5e0) AS BIGINT) AS cell_y, round(avg(x), 4) AS x, round(avg(y), 4) AS y, arg_min(id, seq) AS first_pin,
    count(*) AS pins FROM p GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"))
def cluster_pins(spark, sf_dir):
    pins = views.images(spark, sf_dir).select("profile_id", "seq", "id", "lat", "lng").filter(F.col("lat").isNotNull())
    boxes = views.campus(spark, sf_dir).select("profile_id", geo.bbox(
        F.col("lng") - 0.011, F.col("lat") - 0.011, F.col("lng") + 0.011, F.col("lat") + 0.011).alias("box"))
    return spatial.cluster_pins(pins, boxes).withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


@query("building_type_counts", f"WITH {views.with_views('bldg')} " + """SELECT profile_id, type, count(*) AS buildings,
    count_if(contains(lower(name), 'bolt')) AS matching FROM bldg WHERE inside_campus GROUP BY ALL""")
def building_type_counts(spark, sf_dir):
    return reports.building_type_counts(views.buildings(spark, sf_dir), "bolt")


@query("pick_campus", f"WITH {views.with_views('campus')} " + """, e AS (SELECT s_suppkey, s_nationkey AS profile_id, s_suppkey % 3 AS kind,
    1e-3 * (1 + s_suppkey % 7) AS half FROM supplier WHERE s_suppkey % 5 <> 4), r AS (SELECT e.*, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2
    END AS rank FROM e) SELECT profile_id, element_id, CAST(rank AS INT) AS rank FROM (SELECT profile_id, s_suppkey AS element_id, rank,
    row_number() OVER (PARTITION BY profile_id ORDER BY rank, half DESC, s_suppkey) AS n FROM r) WHERE n = 1""")
def pick_campus(spark, sf_dir):
    campus = views.campus(spark, sf_dir).withColumn("entity_id", F.concat(F.lit("Q"), F.col("profile_id").cast("string")))
    kind, half = F.col("s_suppkey") % 3, (1 + F.col("s_suppkey") % 7) * 1e-3
    place = views.table(spark, sf_dir, "supplier").withColumn("profile_id", F.col("s_nationkey").cast("bigint")).join(
        campus.select("profile_id", "lat", "lng", "entity_id", "names"), "profile_id")
    elements = place.select(
        "profile_id", F.col("s_suppkey").alias("element_id"),
        F.when(F.col("s_suppkey") % 5 == 4, "school").otherwise("university").alias("amenity"), F.lit(None).cast("string").alias("site"),
        F.when(kind == 0, F.col("entity_id")).alias("entity_id"),
        F.when(kind == 1, F.col("names")).otherwise(F.array(F.lit("Zzyx"))).alias("names"),
        views.box_ring(F.col("lng") - half, F.col("lat") - half, F.col("lng") + half, F.col("lat") + half).alias("ring"))
    return spatial.pick_campus(elements, campus, text.name_similarity).select("profile_id", "element_id", "rank")
