"""Text, date and geometry functions on known values and against plain Python."""

import unicodedata

import math
import random
from difflib import SequenceMatcher

import pandas as pd
from helpers import RING
from pyspark.sql import functions as F

from placeproof.functions import dates, geo, labels, rules, text
from placeproof.operators import spatial
from placeproof import schemas


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(*values):
    return [F.lit(v) for v in values]


def test_similarity_bands(spark):
    rows = [("KAIST", "KAIST"), ("Koera Univrsity", "Korea University"), ("Cambridge", "University of Cambridge"),
            ("Xyzzqq Blorft Institute", "Cockcroft Institute"), ("", "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, n string").select(text.name_similarity(F.col("q"), F.col("n"))).collect()]
    assert got[0] == 1.0 and got[1] >= 0.9 and 0.6 <= got[2] < 0.9 and got[3] <= 0.5 and got[4] == 0.0


def test_sentences_keep_initials_and_footnotes(spark):
    long = "Назарбаев Университет — вуз, открытый по инициативе Н. А. Назарбаева. Находится в г. Астана. Кампус большой."
    a, b, c = one(spark, text.split_sentences(F.lit(long)), text.first_sentences(F.lit("One. Two! Three? Four. Five."), 3),
                  text.split_sentences(F.lit("Big campus. [1] Next one [2]. End.")))
    assert a[0].endswith("Н. А. Назарбаева.") and a[1] == "Находится в г. Астана." and len(a) == 3
    assert b == "One. Two! Three?"
    assert c == ["Big campus. [1]", "Next one [2].", "End."]


def test_footnotes(spark):
    cases = [("One [1]. Two [1].", True), ("One [1]. Two.", False), ("Big campus [3].", False), ("No footnote here.", False),
             ("Вуз открыт по инициативе Н. А. Назарбаева [1]. Кампус большой. [1]", True), ("Вуз открыт [1]. Кампус большой.", False)]
    got = spark.createDataFrame(cases, "t string, w boolean").select("w", text.footnotes_valid(F.col("t"), F.lit(1)).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_folding_equals_python(spark):
    samples = ["Straße ﬁn", "ＫＯＲＥＡ　ＵＮＩＶ", "étude", "Å Ⅳ ½ …", "İstanbul", "한국", "가각", "ΣΟΦΟΣ", "x² y", "Ǆ ŉ", "𝔘ni", "ガギ ｶﾞ", "Việt Nam Đại học", "Université de Genève"]
    samples += [unicodedata.normalize(form, s) for s in samples for form in ("NFD", "NFKD")]
    got = spark.createDataFrame([(s,) for s in samples], "s string").select("s", text.fold_text(F.col("s")).alias("g")).collect()
    assert {r["s"]: r["g"] for r in got} == {s: text.fold(s) for s in samples}


def test_folding_of_every_character_and_of_marks_in_any_order(spark):
    assigned = [chr(c) for c in [*range(0x80, 0xD800), *range(0xE000, 0x110000)] if unicodedata.category(chr(c)) not in ("Cn", "Co")]
    samples = [f"x{c}y" for c in assigned] + [f"{base}{a}{b}" for base in "aeouAσα" for a in "\u0301\u0323\u031b\u0345\u0308" for b in "\u0301\u0327\u0340\u0306"]
    got = spark.createDataFrame([(s,) for s in samples], "s string").repartition(8).select("s", text.fold_text(F.col("s")).alias("g")).collect()
    assert [(r["s"], r["g"]) for r in got if r["g"] != text.fold(r["s"])] == []


def test_small_texts(spark):
    got = one(spark, text.title_stem(F.lit("File:Campus_view (cropped).jpg")), text.title_stem(F.lit("IMG_1234.JPG")),
              text.clean_html(F.lit("<b>A &amp; B</b>&nbsp;<i>c</i>")), text.initials(F.lit("Nazarbayev University")),
              text.initials(F.lit("kaist")), text.is_cyrillic(F.lit("вуз")))
    assert got == ("campus view", "", "A & B c", "NU", "KAI", True)


def test_search_names_drop_single_latin_words(spark):
    names = F.array(*lit("University of Cambridge", "Cambridge", "KAIST", "Кембридж"))
    assert one(spark, text.search_names(names))[0] == ["University of Cambridge", "KAIST", "Кембридж"]


def test_dates(spark):
    today = F.lit("2026-09-18").cast("date")
    values = ["2024", "2024-05", "2024-05-02T10:20:30Z", "2024-02-31", "2027-01-01", "+1999-01-01", "0000", "x"]
    got = one(spark, *[dates.normalize_date(F.lit(v), today) for v in values])
    assert got == ("2024", "2024-05", "2024-05-02", None, None, "1999-01-01", None, None)
    got = one(spark, dates.unix_date(F.lit(0), today), dates.unix_date(F.lit("soon"), today),
              dates.unix_date(F.lit(1714565000123), today, millis=True), dates.text_year(today, F.lit("hall 12019"), F.lit("in 2019")),
              dates.freshness(F.lit(None).cast("string"), F.lit(1815)), dates.messy_date(F.lit("<t>on 2019-05 at</t>"), today),
              dates.claim_date(F.lit("+2022-03-04T00:00:00Z"), F.lit(10), today))
    assert got == ("1970-01-01", None, "2024-05-01", 2019, "historic", "2019-05", "2022-03")


def test_shown_numbers(spark):
    got = one(spark, labels.format_distance(F.lit(994.0), "en"), labels.format_distance(F.lit(1250.0), "ru"), geo.format_minutes(F.lit(59)),
              geo.format_minutes(F.lit(125)), geo.walk_minutes(F.lit(0.01)), geo.drive_minutes(F.lit(150.0)),
              geo.display_height_m(F.lit(None).cast("double"), F.lit(0)))
    assert got == ("990 m", "1.2 км", "~59 min", "~2 h 5 min", 1, 2, 12.0)


def test_building_types(spark):
    cases = [({"building": "university"}, "academic"), ({"building:use": "education"}, "academic"), ({"building": "dormitory"}, "dorm"),
             ({"building": "yes", "name": "Student Residence Hall"}, "dorm"), ({"amenity": "library", "building": "yes"}, "library"),
             ({"building": "library"}, "other"), ({"leisure": "fitness_centre"}, "sport"), ({"amenity": "research_institute"}, "lab"),
             ({"office": "research"}, "lab"), ({"amenity": "cafe", "building": "yes"}, "food"), ({"building": "yes"}, "other")]
    got = spark.createDataFrame(cases, "t map<string,string>, w string").select("w", rules.building_type(F.col("t")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_every_rule_word_means_the_same_with_and_without_its_plain_part(spark):
    samples = ["the police station", "police officers", "a protestant", "protest", "campus librarie", "seals and seal", "grève", "gréve",
               "research assistant", "speech hall", "speech", "sem images", "пресс министра", "scan.pdf", "x-ray scans", "sit-ins", "posing", "gras ras"]
    frame = spark.createDataFrame([(s,) for s in samples], "s string")
    for words in (rules.NOT_A_PHOTO, rules.PEOPLE_OR_EVENT, rules.SPECIMEN, rules.SHOWCASE, rules.LAB):
        got = frame.select(rules.matches("s", words).alias("a"), rules.matches(F.col("s"), words).alias("b"),
                           F.col("s").rlike(rules.pattern(words)).alias("c")).collect()
        assert all(r["a"] == r["b"] == r["c"] for r in got)


def test_point_only_search_circle(spark):
    ring = F.lit(None).cast(schemas.RING)
    got = one(spark, geo.search_centers(ring, F.lit(1.0), F.lit(2.0)))[0]
    assert [tuple(c) for c in got] == [(1.0, 2.0, 1000)]


def _inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_buildings_first_in_list_order_wins(spark):
    rng = random.Random(7)
    squares = []
    for i in range(60):
        x, y, side = rng.random() * 0.02, rng.random() * 0.02, 0.001 + rng.random() * 0.004
        squares.append([(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)])
    squares.append([(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)])
    points = [(rng.random() * 0.025, rng.random() * 0.025) for _ in range(300)]
    houses = spark.createDataFrame(
        [(1, i, f"b{i}", "", "other", s, None, None, True) for i, s in enumerate(squares)], schemas.BUILDINGS)
    spots = spark.createDataFrame([(1, i, y, x) for i, (x, y) in enumerate(points)], "profile_id bigint, seq bigint, lat double, lng double")
    want = {i: next((j for j, s in enumerate(squares) if len(s) >= 4 and _inside(x, y, s)), None) for i, (x, y) in enumerate(points)}
    got = {r["seq"]: r["building"]["ord"] for r in spatial.building_at(spots, houses).collect()}
    assert got == {i: j for i, j in want.items() if j is not None}


def test_points_meet_few_of_many_buildings_in_one_place(spark):
    """Two thousand slanted buildings around one square: the first of the list wins, and a cell keeps few outlines."""
    rng = random.Random(3)
    rings = []
    for _ in range(2000):
        x, y, a, b = rng.random() * 0.002, rng.random() * 0.002, 0.0003 + rng.random() * 0.0007, rng.random() * 0.0003
        rings.append([(x, y), (x + a, y + b), (x + a - b, y + a + b), (x - b, y + a), (x, y)])
    houses = spark.createDataFrame([(1, i, f"b{i}", "", "other", r, None, None, True) for i, r in enumerate(rings)], schemas.BUILDINGS)
    places = [(rng.random() * 0.003, rng.random() * 0.003) for _ in range(400)]
    spots = spark.createDataFrame([(1, i, y, x) for i, (x, y) in enumerate(places)], "profile_id bigint, seq bigint, lat double, lng double")
    want = {i: next((j for j, r in enumerate(rings) if _inside(x, y, r)), None) for i, (x, y) in enumerate(places)}
    got = {r["seq"]: r["building"]["ord"] for r in spatial.building_at(spots, houses).collect()}
    assert got == {i: j for i, j in want.items() if j is not None}
    _, _, near = spatial._by_cell(houses, spatial.CELL_DEG)
    tiles = spatial._tiled(houses, geo.bbox_of(F.col("ring")), spatial.CELL_DEG, spatial.FINEST_LEVEL)
    assert near.count() * 3 < tiles.count()


def test_boundary_points_are_outside_and_areas_are_right(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    edges = geo.edges_of(ring)
    got = one(spark, geo.contains(edges, F.lit(127.027), F.lit(37.59)), geo.contains(edges, F.lit(127.03), F.lit(37.59)),
              geo.outside_m(edges, F.lit(127.032), F.lit(37.5955)), geo.area_km2(edges))
    assert got[0] is False and got[1] is True and 160 < got[2] < 175
    assert math.isclose(got[3], 0.01 * 0.01 * 111.32 ** 2 * math.cos(math.radians(37.589)), rel_tol=1e-6)


def test_shapes_of_any_size_take_few_cells(spark):
    """A ring around a country, one around a house in it, and a box around the world, against the plain conditions."""
    def ring(x, y, side):
        return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]

    shapes = spark.createDataFrame(
        [(1, 1, "land", ring(100.0, 10.0, 21.0)), (1, 0, "house", ring(110.0, 20.0, 0.0007)), (1, 2, "spot", ring(90.0, 5.0, 0.0))],
        "profile_id bigint, ord int, building_id string, ring array<struct<x: double, y: double>>").withColumns(
        {"name": F.lit(None).cast("string"), "type": F.lit("other"), "inside_campus": F.lit(False)})
    spots = {1: (20.0003, 110.0003), 2: (20.0, 105.0), 3: (30.9, 120.9), 4: (31.1, 120.9), 5: (10.5, 100.5)}
    points = spark.createDataFrame([(1, seq, *at) for seq, at in spots.items()], "profile_id bigint, seq bigint, lat double, lng double")
    assert spatial._tiled(shapes, geo.bbox_of(F.col("ring")), 0.001).groupBy("building_id").count().agg(F.max("count")).first()[0] <= 25
    got = {r["seq"]: r["building"]["ord"] for r in spatial.building_at(points, shapes).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 5: 1}
    boxes = spark.createDataFrame([(7, (-180.0, -90.0, 180.0, 90.0)), (8, (110.0, 20.0, 110.001, 20.001))], "box_id bigint, box struct<w: double, s: double, e: double, n: double>")
    found = spatial.within_bbox(points, boxes, pad_m=0.0).select("seq", "box_id").collect()
    assert sorted(map(tuple, found)) == sorted([*((s, 7) for s in spots), (1, 8)])
    empty = spatial.within_bbox(points, boxes.limit(0), pad_m=0.0)
    assert empty.count() == 0


def test_words_that_share_few_letters_need_no_ratio(monkeypatch):
    def never(*_):
        raise AssertionError("compared")
    asked, offered = [["cold", "plate"], ["stone"], []], [["ring", "bolts"], ["stone"], ["x"]]
    monkeypatch.setattr(text, "SequenceMatcher", never)
    assert list(text._found_words_udf.func(pd.Series(asked), pd.Series(offered))) == [0, 1, 0]


def test_letter_bound_never_hides_a_near_equal_word():
    draw = random.Random(5)
    words = ["".join(draw.choices("aabcé", k=draw.randint(1, 7))) for _ in range(20000)]
    pairs = [(a, b) for a, b in zip(words, words[1:]) if a != b]
    got = text._found_words_udf.func(pd.Series([[a] for a, _ in pairs]), pd.Series([[b] for _, b in pairs]))
    assert list(got) == [int(SequenceMatcher(None, a, b).ratio() >= text.MIN_TOKEN_RATIO) for a, b in pairs]
