"""Planar and spherical geometry as native column expressions. Rings are arrays of struct<x: lng, y: lat>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_M = 6_371_000.0
KM_PER_DEGREE = 111.32
M_PER_DEGREE = 111_320.0
MAX_CENTERS_PER_SIDE, CENTER_CELL_M, CENTER_OVERLAP = 3, 1500.0, 0.8
CENTER_MIN_M, CENTER_MAX_M, POINT_CENTER_M = 500, 10_000, 1000
MAX_BBOX_DEG2, BBOX_SHRINK = 0.01, 0.99
WALK_KMH = 4.8
LEVEL_M, DEFAULT_HEIGHT_M = 3.2, 12.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = (F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0)))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(h))


def edges_of(ring: Column) -> Column:
    """Consecutive ring points as edges; built once per polygon so that each point test only folds over them."""
    def of(r: Column) -> Column:
        closed = F.when(F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
        return F.element_at(F.transform(F.array(closed), lambda c: F.zip_with(
            F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))), 1)
    return F.element_at(F.transform(F.array(ring), of), 1)


def _crossed_odd(edges: Column, x: Column, y: Column) -> Column:
    return F.size(F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))) % 2 == 1


def _touched(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(edges, lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))))


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Strictly inside by ray casting; a point on the boundary is outside. Edges of several disjoint rings are one shape."""
    return _crossed_odd(edges, x, y) & ~_touched(edges, x, y)


def covers(edges: Column, x: Column, y: Column) -> Column:
    """Inside or on the boundary."""
    return _crossed_odd(edges, x, y) | _touched(edges, x, y)


def _side(a: Column, b: Column, e: Column) -> Column:
    """Side of the line through edge `e` on which (a, b) lies: 1, 0 or -1."""
    return F.signum((e["x2"] - e["x1"]) * (b - e["y1"]) - (e["y2"] - e["y1"]) * (a - e["x1"]))


def _meet(e: Column, f: Column) -> Column:
    """Do two edges share any point?"""
    near = ((F.least(e["x1"], e["x2"]) <= F.greatest(f["x1"], f["x2"])) & (F.least(f["x1"], f["x2"]) <= F.greatest(e["x1"], e["x2"]))
            & (F.least(e["y1"], e["y2"]) <= F.greatest(f["y1"], f["y2"])) & (F.least(f["y1"], f["y2"]) <= F.greatest(e["y1"], e["y2"])))
    return near & (_side(f["x1"], f["y1"], e) * _side(f["x2"], f["y2"], e) <= 0) & (
        _side(e["x1"], e["y1"], f) * _side(e["x2"], e["y2"], f) <= 0)


def is_simple(edges: Column) -> Column:
    """Does a ring neither cross nor touch itself, nor turn back on itself? Compares all edges of one ring: a way has few thousand."""
    def turns_back(e: Column, f: Column) -> Column:
        return (_side(f["x2"], f["y2"], e) == 0) & (
            (e["x2"] - e["x1"]) * (f["x2"] - f["x1"]) + (e["y2"] - e["y1"]) * (f["y2"] - f["y1"]) < 0)

    def of(ring: Column) -> Column:
        last = F.size(ring) - 1
        bad = F.filter(ring, lambda e, i: turns_back(e, F.coalesce(F.get(ring, i + 1), F.get(ring, F.lit(0)))) | F.exists(
            F.slice(ring, i + 3, F.greatest(last - 1 - i - F.when(i == 0, 1).otherwise(0), F.lit(0))), lambda f: _meet(e, f)))
        return (last >= 2) & (F.size(bad) == 0)

    moving = F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    return F.element_at(F.transform(F.array(moving), of), 1)


def interior_point(edges: Column) -> Column:
    """struct<x, y>: middle of the widest stretch inside the ring on a level line that meets no corner, near half its height."""
    def on_line(y: Column) -> Column:
        crossings = F.array_sort(F.transform(F.filter(edges, lambda e: (e["y1"] > y) != (e["y2"] > y)), lambda e: (
            e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]))))
        widest = F.element_at(F.transform(F.array(crossings), lambda c: F.array_max(F.transform(
            F.filter(c, lambda _, i: i % 2 == 0), lambda left, i: F.struct(
                (F.get(c, 2 * i + 1) - left).alias("width"), (-i).alias("first"), ((left + F.get(c, 2 * i + 1)) / 2).alias("x"))))), 1)
        return F.struct(widest["x"].alias("x"), y.alias("y"))

    def level(ys: Column) -> Column:
        half = (F.array_min(ys) + F.array_max(ys)) / 2
        return (F.array_max(F.filter(ys, lambda v: v <= half)) + F.array_min(F.filter(ys, lambda v: v > half))) / 2

    return F.element_at(F.transform(F.transform(F.array(F.transform(edges, lambda e: e["y1"])), level), on_line), 1)


def nearest_on(edges: Column, x: Column, y: Column) -> Column:
    """struct<d2, x, y>: the planar nearest boundary point."""
    def project(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length2 = dx * dx + dy * dy
        t = F.when(length2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(
            F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length2)))
        px, py = e["x1"] + t * dx, e["y1"] + t * dy
        return F.struct(((x - px) * (x - px) + (y - py) * (y - py)).alias("d2"), px.alias("x"), py.alias("y"))
    return F.array_min(F.transform(edges, project))


def outside_m(edges: Column, x: Column, y: Column) -> Column:
    """Metres from an outside point to the ring."""
    near = nearest_on(edges, x, y)
    return haversine_m(y, x, near["y"], near["x"])


def signed_area2(edges: Column) -> Column:
    """Twice the signed planar area, coordinates shifted to the first corner to keep precision."""
    x0, y0 = F.get(edges, F.lit(0))["x1"], F.get(edges, F.lit(0))["y1"]
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + (
        (e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0)))


def planar_area(edges: Column) -> Column:
    return F.abs(signed_area2(edges)) / 2


def centroid(edges: Column) -> Column:
    """struct<x, y>: area centroid of the ring.

    Wrapped in a one-element array, so that the optimizer keeps it as one value and does not unfold it wherever x or y is
    read, such as once per edge of another ring.
    """
    def of(ring: Column) -> Column:
        x0, y0 = F.get(ring, F.lit(0))["x1"], F.get(ring, F.lit(0))["y1"]

        def cross(e: Column) -> Column:
            return (e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0)

        a2 = signed_area2(ring)
        sx = F.aggregate(ring, F.lit(0.0), lambda s, e: s + (e["x1"] + e["x2"] - 2 * x0) * cross(e))
        sy = F.aggregate(ring, F.lit(0.0), lambda s, e: s + (e["y1"] + e["y2"] - 2 * y0) * cross(e))
        return F.struct((x0 + sx / (3 * a2)).alias("x"), (y0 + sy / (3 * a2)).alias("y"))

    return F.element_at(F.transform(F.array(edges), of), 1)


def area_km2(edges: Column) -> Column:
    return planar_area(edges) * F.lit(KM_PER_DEGREE * KM_PER_DEGREE) * F.cos(F.radians(centroid(edges)["y"]))


def bbox_of(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def bbox(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))


def _degrees_lng(lat: Column) -> Column:
    return F.lit(KM_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(0.01))


def point_bbox(lat: Column, lng: Column, half_km: float) -> Column:
    dlat, dlng = F.lit(half_km / KM_PER_DEGREE), F.lit(half_km) / _degrees_lng(lat)
    return bbox(lng - dlng, lat - dlat, lng + dlng, lat + dlat)


def padded_bbox(box: Column, pad_m: float = 250.0) -> Column:
    dlat = F.lit(pad_m / 1000 / KM_PER_DEGREE)
    dlng = F.lit(pad_m / 1000) / _degrees_lng((box["s"] + box["n"]) / 2)
    return bbox(box["w"] - dlng, box["s"] - dlat, box["e"] + dlng, box["n"] + dlat)


def clamp_bbox(box: Column) -> Column:
    """Shrink about the centre when the box is larger than a street-level service accepts."""
    area = (box["e"] - box["w"]) * (box["n"] - box["s"])
    k = F.sqrt(F.lit(MAX_BBOX_DEG2) / area) * F.lit(BBOX_SHRINK)
    cx, cy = (box["w"] + box["e"]) / 2, (box["s"] + box["n"]) / 2
    hw, hh = (box["e"] - box["w"]) / 2 * k, (box["n"] - box["s"]) / 2 * k
    return F.when(area <= MAX_BBOX_DEG2, box).otherwise(bbox(cx - hw, cy - hh, cx + hw, cy + hh))


def in_bbox(box: Column, x: Column, y: Column) -> Column:
    return x.between(box["w"], box["e"]) & y.between(box["s"], box["n"])


def search_centers(ring: Column, lat: Column, lng: Column) -> Column:
    """Up to nine circles covering the outline's box, row by row; one circle around the point without an outline."""
    box = bbox_of(ring)
    height = (box["n"] - box["s"]) * M_PER_DEGREE
    width = (box["e"] - box["w"]) * M_PER_DEGREE * F.greatest(
        F.cos(F.radians((box["s"] + box["n"]) / 2)), F.lit(0.01))

    def count(length: Column) -> Column:
        return F.greatest(F.lit(1), F.least(F.lit(MAX_CENTERS_PER_SIDE), F.ceil(length / CENTER_CELL_M).cast("int")))

    nx, ny = count(width), count(height)
    radius = F.greatest(F.lit(CENTER_MIN_M), F.least(F.lit(CENTER_MAX_M), F.ceil(
        F.greatest(width / nx, height / ny) * CENTER_OVERLAP).cast("int")))
    grid = F.flatten(F.transform(F.sequence(F.lit(0), ny - 1), lambda iy: F.transform(
        F.sequence(F.lit(0), nx - 1), lambda ix: F.struct(
            (box["s"] + (iy + 0.5) * (box["n"] - box["s"]) / ny).alias("lat"),
            (box["w"] + (ix + 0.5) * (box["e"] - box["w"]) / nx).alias("lng"), radius.alias("radius_m")))))
    point = F.array(F.struct(lat.alias("lat"), lng.alias("lng"), F.lit(POINT_CENTER_M).alias("radius_m")))
    return F.when(ring.isNotNull(), grid).when(lat.isNotNull() & lng.isNotNull(), point)


def campus_radius_m(box: Column) -> Column:
    half = haversine_m(box["s"], box["w"], box["n"], box["e"]) / 2
    return F.coalesce(F.greatest(F.lit(1000.0), half), F.lit(1000.0)).cast("int")


def outer_ring(parts: Column) -> Column:
    """Ring of the largest part, coordinates to six decimals."""
    biggest = F.array_max(F.transform(parts, lambda r, i: F.struct(
        planar_area(edges_of(r)).alias("area"), (-i).alias("first"), r.alias("ring"))))["ring"]
    return round_ring(biggest)


def round_ring(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(F.bround(p["x"], 6).alias("x"), F.bround(p["y"], 6).alias("y")))


def heading(value: Column) -> Column:
    return F.bround(F.pmod(value, F.lit(360.0)), 1)


def bearing_to_center(lat: Column, lng: Column, to_lat: Column, to_lng: Column) -> Column:
    """Degrees of the screen marker pointing to the city centre (screen y grows downwards)."""
    return F.degrees(F.atan2(-F.sin(F.atan2(to_lat - lat, to_lng - lng)), F.cos(F.atan2(to_lat - lat, to_lng - lng))))


def walk_minutes(road_km: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(road_km / WALK_KMH * 60, 0).cast("int"))


def drive_minutes(seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(seconds / 60, 0).cast("int"))


def format_minutes(minutes: Column) -> Column:
    return F.when(minutes < 60, F.format_string("~%d min", minutes)).otherwise(
        F.format_string("~%d h %d min", F.floor(minutes / 60).cast("int"), minutes % 60))


def display_height_m(height: Column, levels: Column) -> Column:
    return F.coalesce(height, F.when(levels != 0, levels * LEVEL_M), F.lit(DEFAULT_HEIGHT_M))
