"""Outlines of map elements: open ways, several parts, interior points and rings that cross themselves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from placeproof import schemas
from placeproof.functions import geo, rings
from placeproof.functions.text import name_similarity
from placeproof.operators import spatial
from placeproof.plans import payloads
from placeproof.sources import maps

WAYS = "array<array<struct<x:double,y:double>>>"


def joined(spark, cases):
    """For every list of ways its rings as lists of points."""
    rows = spark.createDataFrame([(i, ways) for i, ways in enumerate(cases)], f"n int, ways {WAYS}").repartition(4)
    done = rings.join_ways(rows, F.col("ways"), "parts").collect()
    return [[[(p["x"], p["y"]) for p in ring] for ring in r["parts"]] for r in sorted(done, key=lambda r: r["n"])]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def pieces(ring, cuts):
    """The ring as open ways cut at these corners, every second one drawn against the rest."""
    ways = [ring[a:b + 1] for a, b in zip(cuts, cuts[1:])] + [ring[cuts[-1]:] + ring[1:cuts[0] + 1]]
    return [w[::-1] if i % 2 else w for i, w in enumerate(ways)]


CASES = {
    "closed ways": ([box(0.0, 0.0, 1.0, 1.0), box(2.0, 2.0, 4.0, 4.0)], [1, 4]),
    "three open ways": (pieces(box(0.0, 0.0, 2.0, 3.0), [0, 1, 3]), [6]),
    "two open ways beside a closed one": (pieces(box(0.0, 0.0, 2.0, 3.0), [1, 2])[::-1] + [box(5.0, 5.0, 6.0, 6.0)], [1, 6]),
    "shared way dissolves": ([[(1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 1.0)], [(1.0, 0.0), (1.0, 1.0)],
                              [(1.0, 1.0), (3.0, 1.0), (3.0, 0.0), (1.0, 0.0)]], [3]),
    "parts that share a node": ([[(0.0, 0.0), (1.0, 1.0), (0.0, 2.0), (0.0, 0.0)][1:], [(0.0, 0.0), (1.0, 1.0)], [(0.0, 2.0), (0.0, 0.0)],
                                 [(1.0, 1.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0)]], [1, 1]),
    "loose end and bridge": ([box(0.0, 0.0, 1.0, 1.0), [(0.0, 0.0), (-3.0, -1.0)], [(0.0, 0.0), (-1.0, 5.0), (8.0, 8.0)], box(8.0, 8.0, 9.0, 9.0)], [1, 1]),
    "inside another": ([box(0.0, 0.0, 9.0, 9.0), box(2.0, 2.0, 4.0, 4.0)], [81]),
    "repeated ways": ([box(0.0, 0.0, 1.0, 1.0)] * 2 + [box(0.0, 0.0, 1.0, 1.0)[::-1]], [1]),
    "nothing enclosed": ([[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (1.0, 1.0)]], []),
    "no ways": ([], []),
    "degenerate": ([[(0.0, 0.0)], [(1.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], [(0.0, None), (1.0, 1.0)]], []),
    "repeated points": ([[(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]], [1]),
}


def test_ways_join_into_rings(spark):
    got = joined(spark, [ways for ways, _ in CASES.values()])
    for (name, (_, areas)), found in zip(CASES.items(), got):
        assert sorted(round(area(r), 9) for r in found) == areas, name
        assert all(r[0] == r[-1] for r in found), name


def covered(cells, size):
    """Cells that can't be reached from outside without crossing a side of the chosen cells."""
    sides = set()
    for x, y in cells:
        sides |= {(x, y, "h"), (x, y + 1, "h"), (x, y, "v"), (x + 1, y, "v")}
    reached, todo = {(-1, -1)}, [(-1, -1)]
    while todo:
        x, y = todo.pop()
        for nx, ny, side in ((x + 1, y, (x + 1, y, "v")), (x - 1, y, (x, y, "v")), (x, y + 1, (x, y + 1, "h")), (x, y - 1, (x, y, "h"))):
            if -1 <= nx <= size and -1 <= ny <= size and side not in sides and (nx, ny) not in reached:
                reached.add((nx, ny))
                todo.append((nx, ny))
    return sides, {(x, y) for x in range(size) for y in range(size)} - reached


def test_random_grids_against_flood_fill(spark):
    size, rng, cases, wanted = 6, random.Random(7), [], []
    for share in (0.1, 0.3, 0.5, 0.5, 0.7, 0.9):
        cells = [(x, y) for x in range(size) for y in range(size) if rng.random() < share]
        sides, inside = covered(cells, size)
        ways = [[(float(x), float(y)), (float(x + (d == "h")), float(y + (d == "v")))] for x, y, d in sides]
        ways = [w[::-1] if rng.random() < 0.5 else w for w in ways]
        rng.shuffle(ways)
        cases.append(ways)
        wanted.append(inside)
    rows = spark.createDataFrame(list(enumerate(cases)), f"n int, ways {WAYS}")
    rows = rings.join_ways(rows, F.col("ways"), "parts").withColumn("edges", F.flatten(F.transform("parts", geo.edges_of)))
    cells = spark.range(size * size).select((F.col("id") % size).cast("int").alias("x"), F.floor(F.col("id") / size).cast("int").alias("y"))
    hits = rows.join(cells, how="cross").where(geo.contains(F.col("edges"), F.col("x") + 0.5, F.col("y") + 0.5)).collect()
    for n, inside in enumerate(wanted):
        assert {(r["x"], r["y"]) for r in hits if r["n"] == n} == inside
    totals = {r["n"]: r["a"] for r in rows.select("n", geo.planar_area(F.col("edges")).alias("a")).collect()}
    assert [round(totals[n] or 0) for n in range(len(wanted))] == [len(inside) for inside in wanted]


def test_long_chain_of_ways(spark):
    corners = box(0.0, 0.0, 1000.0, 1.0)
    top = [[(float(i), 1.0), (float(i + 1), 1.0)] for i in range(1000)]
    random.Random(3).shuffle(top)
    (found,) = joined(spark, [top + [corners[:3], [corners[3], corners[4]]]])
    assert [round(area(r)) for r in found] == [1000] and len(found[0]) == 1001 + 2 + 1


def test_interior_points_and_crossing_rings(spark):
    shapes = {
        "square": box(0.0, 0.0, 2.0, 2.0),
        "ell": [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)],
        "cup": [(0.0, 0.0), (5.0, 0.0), (5.0, 4.0), (3.0, 4.0), (3.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0), (0.0, 0.0)],
        "bow tie": [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)],
        "spike": [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (2.0, 5.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)],
        "touching itself": [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0), (0.0, 0.0)],
        "flat": [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)],
        "repeated corner": [(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)],
        "straight corner": [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)],
    }
    rows = spark.createDataFrame(list(shapes.items()), "name string, ring array<struct<x:double,y:double>>").withColumn(
        "edges", geo.edges_of(F.col("ring"))).withColumn("p", geo.interior_point(F.col("edges")))
    found = {r["name"]: r for r in rows.select("name", "p", geo.is_simple(F.col("edges")).alias("simple"), geo.contains(
        F.col("edges"), F.col("p.x"), F.col("p.y")).alias("inside")).collect()}
    assert {n for n, r in found.items() if r["simple"]} == {"square", "ell", "cup", "repeated corner", "straight corner"}
    assert all(r["inside"] for r in found.values() if r["simple"])
    assert tuple(found["ell"]["p"]) == (0.5, 2.0) and tuple(found["cup"]["p"]) == (4.0, 2.5)


def _points(way):
    return [{"lon": x, "lat": y} for x, y in way]


@pytest.fixture(scope="module")
def campus_parts(spark):
    """A relation of a square drawn by two open ways, a larger second part and an inner way; a building near each."""
    outer = [[(0.0, 0.0), (0.01, 0.0), (0.01, 0.01)], [(0.0, 0.0), (0.0, 0.01), (0.01, 0.01)], box(0.03, 0.0, 0.05, 0.02)]
    members = [{"type": "way", "role": "outer", "geometry": _points(w)} for w in outer] + [
        {"type": "way", "role": "inner", "geometry": _points(box(0.035, 0.005, 0.04, 0.01))},
        {"type": "node", "role": "", "geometry": None}, {"type": "way", "role": "outer", "geometry": None}]
    elements = [{"type": "relation", "id": 7, "tags": {"amenity": "university", "wikidata": "Q1"}, "members": members},
                {"type": "way", "id": 8, "tags": {"amenity": "university", "wikidata": "Q1"}, "geometry": _points(
                    [(-1.0, -1.0), (1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)])},
                {"type": "relation", "id": 9, "tags": {"amenity": "university", "wikidata": "Q1"}, "members": []}]
    for number, x in enumerate((0.005, 0.04, 0.02)):
        elements.append({"type": "way", "id": 20 + number, "tags": {"building": "yes"}, "geometry": _points(box(x, 0.005, x + 1e-4, 0.0051))})
    elements.append({"type": "way", "id": 30, "tags": {"building": "yes"}, "geometry": _points(
        [(0.001, 0.001), (0.002, 0.002), (0.002, 0.001), (0.001, 0.002), (0.001, 0.001)])})
    payloads = spark.createDataFrame([(1, i, json.dumps(e)) for i, e in enumerate(elements)], "profile_id bigint, seq bigint, payload string")
    read = maps.read_elements(payloads)
    universities = spark.createDataFrame([(1, "Q2", ["U"], 0.005, 0.005)], "profile_id bigint, entity_id string, names array<string>, lat double, lng double")
    chosen = spatial.pick_campus(maps.campus_elements(read), universities, name_similarity)
    return read, chosen


def test_campus_of_open_ways_holds_its_point(campus_parts):
    _, chosen = campus_parts
    (row,) = chosen.collect()
    assert (row["element_id"], row["rank"], len(row["parts"])) == (7, 2, 2)
    assert row["area"] == pytest.approx(0.01 ** 2 + 0.02 ** 2)
    assert {p["x"] for p in row["ring"]} == {0.03, 0.05}


def test_buildings_and_photos_by_all_parts(spark, campus_parts):
    read, chosen = campus_parts
    outline = chosen.select("profile_id", "ring", "parts", F.lit(0.005).alias("lat"), F.lit(0.005).alias("lng"))
    buildings = maps.normalize_buildings(read)
    near = spatial.buildings_near_campus(buildings, outline).collect()
    assert {(r["building_id"], r["inside_campus"]) for r in near} == {("way-20", True), ("way-21", True)}
    photos = spark.createDataFrame(
        [(1, "first", 0.005, 0.005), (1, "second", 0.01, 0.045), (1, "hole", 0.0075, 0.0375), (1, "between", 0.005, 0.02)],
        "profile_id bigint, id string, lat double, lng double")
    whole = {r["id"]: r["geo"]["key"] for r in spatial.locate_on_campus(photos, outline, whole=True).collect()}
    assert whole == {"first": "geo_inside", "second": "geo_inside", "hole": "geo_inside", "between": "geo_away"}
    largest = {r["id"]: r["geo"]["key"] for r in spatial.locate_on_campus(photos, outline).collect()}
    assert largest == {"first": "geo_away", "second": "geo_inside", "hole": "geo_inside", "between": "geo_away"}


def test_nearby_buildings_compute_their_point_once(spark):
    empty = spark.createDataFrame([], schemas.BUILDINGS), spark.createDataFrame([], schemas.CAMPUS)
    plan = spatial.buildings_near_campus(*empty)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1


def test_elements_are_dealt_out_before_their_ways_are_joined(spark, tmp_path):
    """A file of short rows is one split; the work on them is not."""
    spark.range(40).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "'name' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = payloads.join_outlines(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == sum(i % 4 != 0 or i % 3 == 0 for i in range(40))


def test_payloads_are_parsed_once_after_they_are_dealt_out(spark, tmp_path):
    """No test for null ids that parses them in the few tasks of the scan."""
    spark.range(40).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "'name' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    plan = payloads.join_outlines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
