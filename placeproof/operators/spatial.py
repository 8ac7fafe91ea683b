"""Points against campus outlines, buildings, boxes and circles.

Every join is an equality join: on the profile, or on a grid cell when a box or a ring has to be found first.
Small sides are left to Spark, which broadcasts only below its size limit and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.functions import geo
from placeproof.functions.rings import let

# Weight of a photo point by where it lies.
INSIDE, EDGE, JUST_OUTSIDE = 28, 12, 4
NEAR_POINT, AROUND_POINT, UNSURE_POINT = 20, 6, 0
AWAY, FAR, NO_POINT = -10, -30, -6
EDGE_M, JUST_OUTSIDE_M, AWAY_M = 250, 1000, 3000
NEAR_POINT_M, AROUND_POINT_M, UNSURE_POINT_M, AWAY_POINT_M = 500, 1500, 3000, 10_000
NEARBY_BUILDING_M = 100.0
NAME_MATCH = 0.8
CELL_DEG, WIDE_CELL_DEG = 0.001, 0.05
CELLS_PER_SIDE = 4
FINEST_LEVEL = -4


def _shape_edges(df: DataFrame) -> Column:
    """Edges of all `parts` where the table has them, else of `ring`."""
    if "parts" not in df.columns:
        return geo.edges_of(F.col("ring"))
    return F.when(F.size("parts") > 0, F.flatten(F.transform("parts", geo.edges_of))).otherwise(geo.edges_of(F.col("ring")))


def with_outline(campus: DataFrame, whole: bool = False) -> DataFrame:
    """Adds the edge list and the outline's own centre, once per campus; `whole` takes all parts instead of the largest."""
    edges = F.when(F.size("ring") >= 4, _shape_edges(campus) if whole else geo.edges_of(F.col("ring")))
    return campus.withColumn("edges", edges).withColumn("ring_center", geo.centroid(F.col("edges")))


def position(lat: Column, lng: Column, c_lat: Column, c_lng: Column, edges: Column, ring_center: Column) -> Column:
    """struct<key, meters, weight, on_campus> for one photo point; on_campus is null when it cannot be told."""
    def result(key: str, meters: Column, weight: int, on_campus: bool | None) -> Column:
        return F.struct(
            F.lit(key).alias("key"), meters.cast("double").alias("meters"), F.lit(weight).alias("weight"),
            F.lit(on_campus).cast("boolean").alias("on_campus"))

    nothing = F.lit(None)
    no_point = result("no_geo", nothing, NO_POINT, None)
    known_center = c_lat.isNotNull() & c_lng.isNotNull()
    from_center = F.when(known_center, geo.haversine_m(c_lat, c_lng, lat, lng)).otherwise(
        geo.haversine_m(ring_center["y"], ring_center["x"], lat, lng))
    away = geo.outside_m(edges, lng, lat)
    outlined = (
        F.when(geo.contains(edges, lng, lat), result("geo_inside", from_center, INSIDE, True))
        .otherwise(F.element_at(F.transform(F.array(away), lambda m: (
            F.when(m <= EDGE_M, result("geo_edge", m, EDGE, False))
            .when(m <= JUST_OUTSIDE_M, result("geo_just_outside", m, JUST_OUTSIDE, False))
            .when(m <= AWAY_M, result("geo_away", m, AWAY, False))
            .otherwise(result("geo_away", m, FAR, False)))), 1))
    )
    pointed = F.element_at(F.transform(F.array(geo.haversine_m(c_lat, c_lng, lat, lng)), lambda m: (
        F.when(m <= NEAR_POINT_M, result("geo_near_point", m, NEAR_POINT, True))
        .when(m <= AROUND_POINT_M, result("geo_point", m, AROUND_POINT, None))
        .when(m <= UNSURE_POINT_M, result("geo_point", m, UNSURE_POINT, None))
        .when(m <= AWAY_POINT_M, result("geo_away", m, AWAY, False))
        .otherwise(result("geo_away", m, FAR, False)))), 1)
    return (
        F.when(lat.isNull() | lng.isNull(), no_point)
        .when(edges.isNotNull(), outlined)
        .when(known_center, pointed)
        .otherwise(no_point)
    )


def locate_on_campus(images: DataFrame, campus: DataFrame, whole: bool = False) -> DataFrame:
    """Images with `geo`: where the photo point lies and what that is worth.

    Of a campus of several parts the largest counts, as in the studied scoring; with `whole` all `parts` do.
    """
    shape = with_outline(campus, whole).select(
        "profile_id", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"), "edges", "ring_center")
    return images.join(shape, "profile_id", "left").withColumn("geo", position(
        F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"), F.col("edges"), F.col("ring_center"))).drop(
        "c_lat", "c_lng", "edges", "ring_center")


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("bigint")


def _sized(df: DataFrame, box: Column, size: float, finest: int = 0) -> DataFrame:
    """Adds the box and its grid `level`, from `finest` up: cells double until at most `CELLS_PER_SIDE` go along a side."""
    boxed = df.withColumn("_box", box)
    side = F.greatest(F.col("_box.e") - F.col("_box.w"), F.col("_box.n") - F.col("_box.s"))
    level = F.greatest(F.lit(finest), F.ceil(F.log2(side / (size * CELLS_PER_SIDE)))).cast("int")
    return boxed.withColumn("level", F.when(side > 0, level).otherwise(F.when(side.isNotNull(), finest)))


def _cell_size(size: float) -> Column:
    return F.lit(size) * F.pow(F.lit(2.0), F.col("level"))


def _tiled(df: DataFrame, box: Column, size: float, finest: int = 0) -> DataFrame:
    """One row per grid cell that the box touches, on a grid of its own `level`, so a box of any size has at most
    (`CELLS_PER_SIDE` + 1) squared rows."""
    return _cells(df, box, size, finest).drop("_box", "_size")


def _cells(df: DataFrame, box: Column, size: float, finest: int) -> DataFrame:
    sized = _sized(df, box, size, finest).withColumn("_size", _cell_size(size))

    def along(low: str, high: str) -> Column:
        return F.sequence(_cell(F.col(f"_box.{low}"), F.col("_size")), _cell(F.col(f"_box.{high}"), F.col("_size")))

    cells = F.flatten(F.transform(along("w", "e"), lambda x: F.transform(along("s", "n"), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    return sized.withColumn("_cell", F.explode(cells)).withColumns({"cx": F.col("_cell.cx"), "cy": F.col("_cell.cy")}).drop("_cell")


def _keyed(points: DataFrame, sized: DataFrame, size: float) -> DataFrame:
    """Points once for each level that occurs (few: every level doubles the cells), with their cell there."""
    levels = sized.agg(F.collect_set("level")).scalar()
    leveled = points.withColumn("level", F.explode(levels)).withColumn("_size", _cell_size(size))
    return leveled.withColumns({"cx": _cell(F.col("lng"), F.col("_size")), "cy": _cell(F.col("lat"), F.col("_size"))}).drop("_size")


def _with_part(shapes: DataFrame, cell: float, part: str) -> DataFrame:
    """One row per cell of which a shape holds 'some' or 'all', without the outline.

    A cell at the border of the shape's box counts as 'some' without a look. Cells are taken a little larger than they are, so that rounding at their borders never makes a cell whole. An edge
    whose box meets the cell leaves it at 'some'; a cell that none meets lies inside or outside as its middle does. All cells of a
    shape are judged in its own row: edges that miss a column of cells are out for all of them.
    """
    size, edges = F.col("_size"), F.col("edges")
    slack = size / 1000
    sized = _sized(shapes, geo.bbox_of(F.col("ring")), cell, FINEST_LEVEL).withColumn("_size", _cell_size(cell)).withColumns({
        "_x0": _cell(F.col("_box.w"), F.col("_size")), "_x1": _cell(F.col("_box.e"), F.col("_size")),
        "_y0": _cell(F.col("_box.s"), F.col("_size")), "_y1": _cell(F.col("_box.n"), F.col("_size")),
        "_spans": F.transform("edges", lambda e: F.struct(
            F.least(e["x1"], e["x2"]).alias("w"), F.least(e["y1"], e["y2"]).alias("s"),
            F.greatest(e["x1"], e["x2"]).alias("e"), F.greatest(e["y1"], e["y2"]).alias("n")))})

    def judged(x: Column, y: Column, w: Column, s: Column, near: Column) -> Column:
        e, n = w + size + 2 * slack, s + size + 2 * slack
        inner = (x > F.col("_x0")) & (x < F.col("_x1")) & (y > F.col("_y0")) & (y < F.col("_y1"))
        met = F.exists(near, lambda b: (b["s"] <= n) & (b["n"] >= s))
        if part == "all":
            return inner & ~F.coalesce(met, F.lit(False)) & geo.contains(edges, (w + e) / 2, (s + n) / 2)
        return ~inner | met

    def column(x: Column) -> Column:
        w = x * size - slack
        near = F.filter("_spans", lambda b: (b["w"] <= w + size + 2 * slack) & (b["e"] >= w))
        return let(near, lambda spans: F.transform(F.filter(
            F.sequence("_y0", "_y1"), lambda y: judged(x, y, w, y * size - slack, spans)), lambda y: F.struct(x.alias("cx"), y.alias("cy"))))

    cells = F.flatten(F.transform(F.sequence("_x0", "_x1"), column))
    return sized.withColumn("_cell", F.explode(cells)).select("profile_id", "level", "_cell.cx", "_cell.cy", "building")


CELL = ["profile_id", "level", "cx", "cy"]


def _by_cell(buildings: DataFrame, cell: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Levels of buildings, the first building that holds a cell as a whole, and the outlines before it that meet the cell."""
    rings = buildings.filter(F.size("ring") >= 4).select(
        "profile_id", F.struct("ord", "building_id", "name", "type", "inside_campus").alias("building"), "ring")
    shapes = rings.repartition("profile_id", "building").withColumn("edges", geo.edges_of(F.col("ring")))
    whole = _with_part(shapes, cell, "all").groupBy(*CELL).agg(F.min("building").alias("whole"))
    before = _with_part(shapes, cell, "some").join(whole, CELL, "left").filter(
        F.col("whole").isNull() | (F.col("building") < F.col("whole"))).drop("whole")
    outlines = rings.select(F.col("profile_id").alias("_p"), F.col("building").alias("_b"), geo.edges_of(F.col("ring")).alias("edges"))
    # By shuffle: the size estimate doesn't count the cells that a building becomes, so a broadcast would exceed its limit.
    near = before.hint("merge").join(outlines, (F.col("profile_id") == F.col("_p")) & F.col("building").eqNullSafe(F.col("_b"))).drop("_p", "_b")
    return _sized(rings, geo.bbox_of(F.col("ring")), cell, FINEST_LEVEL), whole, near


def building_at(points: DataFrame, buildings: DataFrame, cell: float = CELL_DEG) -> DataFrame:
    """(profile_id, seq, building struct) for points inside a building; overlaps go to the lowest `ord`.

    Where buildings overlap, a cell that lies inside one as a whole needs none after it: points are tested only against those before it
    whose outline meets the cell. So a point meets a few outlines, however many buildings lie upon each other.
    """
    sized, whole, near = _by_cell(buildings, cell)
    located = _keyed(points.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("profile_id", "seq", "lat", "lng"), sized, cell)
    tested = located.join(near, CELL).filter(geo.contains(F.col("edges"), F.col("lng"), F.col("lat"))).select("profile_id", "seq", "building")
    covered = located.join(whole, CELL).select("profile_id", "seq", F.col("whole").alias("building"))
    return tested.unionByName(covered).groupBy("profile_id", "seq").agg(F.min("building").alias("building"))


def link_photos(photos: DataFrame, buildings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pins with the building each falls into, and one row per (building, photo)."""
    hits = building_at(photos, buildings).select("profile_id", "seq", F.col("building.building_id").alias("building_id"))
    pins = photos.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).join(
        hits, ["profile_id", "seq"], "left")
    links = pins.filter(F.col("building_id").isNotNull()).select(
        "profile_id", "building_id", F.col("id").alias("photo_id"), "seq")
    return pins, links


def building_photos(buildings: DataFrame, links: DataFrame) -> DataFrame:
    """Photo ids as rows of each building in order; a building without photos keeps one row with no photo."""
    return buildings.join(links, ["profile_id", "building_id"], "left")


def buildings_near_campus(buildings: DataFrame, campus: DataFrame, within_m: float = NEARBY_BUILDING_M) -> DataFrame:
    """Buildings with an interior point inside the outline (any of its `parts`, if given) or close to it."""
    shape = with_outline(campus, whole=True).select("profile_id", F.col("edges").alias("c_edges"))
    centered = buildings.dropDuplicates(["profile_id", "building_id"]).join(shape, "profile_id", "left")
    limit = within_m / geo.KM_PER_DEGREE / 1000

    def judge(edges: Column, c: Column) -> Column:
        inside = F.coalesce(geo.contains(edges, c["x"], c["y"]), F.lit(False))
        near = edges.isNull() | inside | (F.sqrt(geo.nearest_on(edges, c["x"], c["y"])["d2"]) < limit)
        return F.when(near, F.array(inside))

    # Generated rather than filtered, so that the optimizer doesn't compute the point anew wherever it is read.
    verdict = let(geo.interior_point(geo.edges_of(F.col("ring"))), lambda c: judge(F.col("c_edges"), c))
    return centered.drop("inside_campus").withColumn("inside_campus", F.explode(verdict)).select(*dict.fromkeys([*buildings.columns, "inside_campus"]))


def within_bbox(points: DataFrame, boxes: DataFrame, pad_m: float = 250.0, cell: float = WIDE_CELL_DEG) -> DataFrame:
    """Every (point, profile) pair where the point lies in the profile's padded box."""
    padded = boxes.withColumn("box", geo.padded_bbox(F.col("box"), pad_m))
    tiled = _tiled(padded, F.col("box"), cell)
    return _keyed(points, _sized(padded, F.col("box"), cell), cell).join(tiled, ["level", "cx", "cy"]).filter(
        geo.in_bbox(F.col("box"), F.col("lng"), F.col("lat"))).drop("level", "cx", "cy")


def within_radius(points: DataFrame, circles: DataFrame, cell: float = WIDE_CELL_DEG) -> DataFrame:
    """(point, profile) pairs where the point lies in any of the profile's circles; radius kept in 10 m .. 10 km."""
    radius = F.greatest(F.lit(10.0), F.least(F.col("radius_m").cast("double"), F.lit(10_000.0)))
    sized = circles.select("profile_id", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"), radius.alias("radius"))
    half_lat = F.col("radius") / geo.M_PER_DEGREE * 1.01
    half_lng = half_lat / F.greatest(F.cos(F.radians(F.col("c_lat"))) - 0.01, F.lit(0.01))
    box = geo.bbox(F.col("c_lng") - half_lng, F.col("c_lat") - half_lat, F.col("c_lng") + half_lng, F.col("c_lat") + half_lat)
    tiled = _tiled(sized, box, cell)
    near = _keyed(points, _sized(sized, box, cell), cell).join(tiled, ["level", "cx", "cy"]).filter(
        geo.haversine_m(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng")) <= F.col("radius"))
    return near.select(*points.columns, "profile_id").distinct()


def ring_metrics(shapes: DataFrame) -> DataFrame:
    """Box, area and centroid of each ring."""
    edged = shapes.withColumn("_edges", geo.edges_of(F.col("ring")))
    return edged.withColumns({
        "box": geo.bbox_of(F.col("ring")), "area_km2": geo.area_km2(F.col("_edges")),
        "center": geo.centroid(F.col("_edges"))}).drop("_edges")


def pick_campus(elements: DataFrame, universities: DataFrame, similarity) -> DataFrame:
    """The best mapped outline per profile: tagged with its id, else containing its point (by name first), larger first.

    `elements` carry profile_id, element_id, amenity, site, entity_id, names[] and ring, and may carry `parts`, which then hold the
    point and give the area; `similarity(a, b)` compares two name columns. Only elements that contain the point but lack the
    tag are compared by name.
    """
    placed = elements.filter(
        F.col("amenity").isin("university", "college") | (F.col("site") == "university")).filter(
        F.size("ring") >= 4).join(universities.select(
            "profile_id", F.col("entity_id").alias("u_entity"), F.col("names").alias("u_names"),
            F.col("lat").alias("u_lat"), F.col("lng").alias("u_lng")), "profile_id").withColumn(
        "_e", _shape_edges(elements)).withColumns({
            "tagged": F.coalesce(F.col("entity_id") == F.col("u_entity"), F.lit(False)),
            "holds": F.coalesce(geo.contains(F.col("_e"), F.col("u_lng"), F.col("u_lat")), F.lit(False)),
            "area": geo.planar_area(F.col("_e"))}).filter(F.col("area") > 0).drop("_e")
    compared = placed.filter(F.col("holds") & ~F.col("tagged")).select(
        "profile_id", "element_id", F.explode("names").alias("name"), "u_names").withColumn(
        "u_name", F.explode("u_names")).filter(
        similarity(F.col("u_name"), F.col("name")) >= NAME_MATCH).select("profile_id", "element_id").distinct()
    named = placed.join(compared.withColumn("named", F.lit(True)), ["profile_id", "element_id"], "left")
    rank = F.when(F.col("tagged"), 0).when(F.col("holds") & F.col("named"), 1).when(F.col("holds"), 2)
    best = Window.partitionBy("profile_id").orderBy("rank", F.desc("area"), "element_id")
    return named.withColumn("rank", rank).filter(F.col("rank").isNotNull()).withColumn(
        "_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "named", "u_names", "u_lat", "u_lng", "u_entity")


def cluster_pins(pins: DataFrame, boxes: DataFrame, cell: float = 13.0) -> DataFrame:
    """Pins collapsed on a percent grid of the map box: mean position, first pin and count per cell."""
    box = boxes.select("profile_id", "box")
    x = (F.col("lng") - F.col("box.w")) / (F.col("box.e") - F.col("box.w")) * 100
    y = (F.col("box.n") - F.col("lat")) / (F.col("box.n") - F.col("box.s")) * 100
    placed = pins.join(box, "profile_id").withColumns({"x": x, "y": y})
    return placed.groupBy(
        "profile_id", F.floor(F.col("x") / cell + 0.5).alias("cell_x"), F.floor(F.col("y") / cell + 0.5).alias("cell_y")
    ).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min_by("id", "seq").alias("first_pin"), F.count("*").alias("pins"))
