"""Ways joined into the rings they enclose, inside one row: columns only, so neither a shuffle nor Python is needed.

A way is an array of points and meets other ways at its two ends. It counts as two halves, one for each direction: number 2i runs
along way i, 2i + 1 against it. The half after another is the next one clockwise around the node where that one ends, so following
halves walks around the face on their left. Least numbers and sums along such a walk are found by pointer jumping, whose
number of rounds is the logarithm of the number of halves. Steps are columns of their own, each read through `let`, so that none is
computed again for every element of an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.functions import geo


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _run_starts(rows: Column, same: Callable[[Column, Column], Column]) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | ~same(F.get(rows, i), F.get(rows, i - 1)))


def _run_end(starts: Column, run: Column, rows: Column) -> Column:
    return F.coalesce(F.get(starts, run + 1), F.size(rows)) - 1


def _departures(ways: Column) -> Column:
    """struct<x, y, angle, half> of every half, sorted: halves of one node stand together, counter-clockwise."""
    def leave(start: Column, then: Column, half: Column) -> Column:
        return F.struct(start["x"].alias("x"), start["y"].alias("y"),
                        F.atan2(then["y"] - start["y"], then["x"] - start["x"]).alias("angle"), half.alias("half"))
    return F.array_sort(F.flatten(F.transform(ways, lambda w, i: F.array(
        leave(F.get(w, F.lit(0)), F.get(w, F.lit(1)), 2 * i),
        leave(F.get(w, F.size(w) - 1), F.get(w, F.size(w) - 2), 2 * i + 1)))))


def _next_halves(out: Column) -> Column:
    """By half: the half that goes on around the face on its left; `out` are the sorted departures."""
    def clockwise(starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda s, run: let(_run_end(starts, run, out), lambda last: (
            F.when(last == s, F.array(s)).otherwise(F.concat(F.array(last), F.sequence(s, last - 1)))))))

    starts = _run_starts(out, lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"]))
    numbered = F.array_sort(F.transform(out, lambda o, i: F.struct(o["half"].alias("half"), i.alias("place"))))
    return let(let(starts, clockwise), lambda before: let(numbered, lambda place: F.transform(
        place, lambda _, h: F.get(out, F.get(before, F.get(place, h.bitwiseXOR(F.lit(1)))["place"]))["half"])))


def _jump(state: Column, step: Callable[[Column, Column], Column]) -> Column:
    """`step(own, that of the half pointed at)` for all halves, often enough to walk around every face."""
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(state))).cast("int"))
    return F.aggregate(rounds, state, lambda now, _: F.transform(now, lambda a: step(a, F.get(now, a["to"]))))


def _least_halves(following: Column) -> Column:
    """By half: the least half of its face."""
    start = F.transform(following, lambda n, h: F.struct(h.alias("face"), n.alias("to")))
    return F.transform(let(start, lambda state: _jump(state, lambda a, b: F.struct(
        F.least(a["face"], b["face"]).alias("face"), b["to"].alias("to")))), lambda s: s["face"])


def _half_areas(ways: Column) -> Column:
    """By half: twice the area between it and the first point of all."""
    origin = F.get(F.get(ways, F.lit(0)), F.lit(0))

    def along(way: Column, zero: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(way) - 1), F.lit(0.0), lambda s, i: s + (
            (F.get(way, i - 1)["x"] - zero["x"]) * (F.get(way, i)["y"] - zero["y"])
            - (F.get(way, i)["x"] - zero["x"]) * (F.get(way, i - 1)["y"] - zero["y"])))
    return let(origin, lambda zero: F.flatten(F.transform(ways, lambda w: let(along(w, zero), lambda v: F.array(v, -v)))))


def _sums(following: Column, faces: Column, areas: Column) -> Column:
    """By half: struct<face, area2, rank>. A face goes by the least of its halves; there area2 is its whole doubled area, positive for
    a face that is enclosed. rank falls along the walk from that half."""
    start = F.transform(following, lambda n, h: F.struct(
        F.get(faces, h).alias("face"), F.get(areas, h).alias("area2"), F.lit(1).alias("rank"),
        F.when(n != F.get(faces, h), n).alias("to")))
    return let(start, lambda state: _jump(state, lambda a, b: F.when(a["to"].isNull(), a).otherwise(F.struct(
        a["face"].alias("face"), (a["area2"] + b["area2"]).alias("area2"), (a["rank"] + b["rank"]).alias("rank"), b["to"].alias("to")))))


def _with_faces(df: DataFrame) -> DataFrame:
    """Adds `_faces`, by half, to rows with `_ways`; null where there are none."""
    some = F.size("_ways") > 0
    out = df.withColumn("_out", F.when(some, let(F.col("_ways"), _departures)))
    following = out.withColumn("_next", let(F.col("_out"), lambda o: F.when(o.isNotNull(), _next_halves(o))))
    least = following.withColumn("_least", let(F.col("_next"), lambda n: F.when(n.isNotNull(), _least_halves(n))))
    sized = least.withColumn("_areas", F.when(some, let(F.col("_ways"), _half_areas)))
    return sized.withColumn("_faces", let(F.struct("_next", "_least", "_areas"), lambda s: F.when(
        s["_next"].isNotNull(), _sums(s["_next"], s["_least"], s["_areas"])))).drop("_out", "_next", "_least", "_areas")


def _enclosed(faces: Column, half: Column) -> Column:
    return F.get(faces, F.get(faces, half)["face"])["area2"] > 0


def _keep(df: DataFrame, wanted: Callable[[Column, Column], Column]) -> DataFrame:
    """Of `_ways` those for which `wanted(faces, i)` holds."""
    kept = let(F.struct("_ways", "_faces"), lambda s: F.filter(s["_ways"], lambda _, i: wanted(s["_faces"], i)))
    return _with_faces(df).withColumn("_ways", kept).drop("_faces")


def _walks(ways: Column, faces: Column) -> Column:
    """Closed rings around the enclosed faces, counter-clockwise."""
    def points(half: Column) -> Column:
        way = F.get(ways, F.shiftright(half, 1))
        return let(F.when(half % 2 == 0, way).otherwise(F.reverse(way)), lambda w: F.slice(w, 1, F.size(w) - 1))

    def cut(steps: Column) -> Column:
        return let(_run_starts(steps, lambda a, b: a["face"] == b["face"]), lambda starts: F.transform(starts, lambda at, run: let(
            F.flatten(F.transform(F.slice(steps, at + 1, _run_end(starts, run, steps) - at + 1), lambda e: points(e["half"]))),
            lambda ring: F.concat(ring, F.slice(ring, 1, 1)))))

    steps = F.array_sort(F.filter(F.transform(faces, lambda f, h: F.struct(
        f["face"].alias("face"), (-f["rank"]).alias("turn"), h.alias("half"))), lambda s: _enclosed(faces, s["half"])))
    return let(steps, lambda s: F.when(F.size(s) > 0, cut(s)))


def _outermost(rings: Column) -> Column:
    """Rings that lie in no larger one."""
    def drop(sized: Column) -> Column:
        def within(small: Column, large: Column) -> Column:
            corners = small["ring"]
            return (large["area"] > small["area"]) & F.exists(corners, lambda p: geo.contains(large["edges"], p["x"], p["y"])) & F.forall(
                corners, lambda p: geo.covers(large["edges"], p["x"], p["y"]))
        return F.transform(F.filter(sized, lambda a: ~F.exists(sized, lambda b: within(a, b))), lambda a: a["ring"])

    measured = F.transform(rings, lambda r: let(geo.edges_of(r), lambda e: F.struct(
        r.alias("ring"), e.alias("edges"), geo.planar_area(e).alias("area"))))
    return F.when(F.size(rings) > 1, let(measured, drop)).otherwise(rings)


def join_ways(df: DataFrame, ways: Column, name: str) -> DataFrame:
    """Adds `name`: rings around the area that `ways` (array<array<struct<x, y>>>) enclose together; empty if they enclose none.

    Open ways join at common ends, in any order and direction. Closed ways are rings by themselves. Faces that share a way become one
    part, parts that share only a node stay two, what lies inside a part is covered by it. Ways that enclose nothing (loose
    ends, bridges between rings) don't count, nor do repeated ways and ways with a missing coordinate. Rings are closed and run
    counter-clockwise. Ways that cross where neither ends are not cut there. No ways (null) give null.
    """
    known = F.filter(ways, lambda w: F.forall(w, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    moving = F.filter(F.transform(known, lambda w: F.filter(w, lambda p, i: (i == 0) | (p != F.get(w, i - 1)))), lambda w: F.size(w) > 1)
    single = df.withColumn("_ways", F.array_distinct(F.transform(moving, lambda w: F.least(w, F.reverse(w)))))
    no_bridges = _keep(single, lambda faces, i: F.get(faces, 2 * i)["face"] != F.get(faces, 2 * i + 1)["face"])
    border = _with_faces(_keep(no_bridges, lambda faces, i: _enclosed(faces, 2 * i) != _enclosed(faces, 2 * i + 1)))
    walked = border.withColumn("_walks", let(F.struct("_ways", "_faces"), lambda s: F.when(
        s["_faces"].isNotNull(), _walks(s["_ways"], s["_faces"]))))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return walked.withColumn(name, F.when(F.col("_ways").isNotNull(), F.coalesce(let(F.col("_walks"), _outermost), none))).drop(
        "_ways", "_faces", "_walks")
