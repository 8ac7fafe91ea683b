"""Scored facts: inputs and the tier, category or evidence they must give."""

import unicodedata

import pytest
from helpers import IN_LIBRARY, INSIDE, NAMES, RING, STREET, buildings, campus, images

from placeproof.operators import evidence, ranking, verdicts
from placeproof.session import cut_lineage
from pyspark.sql import functions as F

CATEGORY = {"matched_category": "Korea University"}
MIT = ["Massachusetts Institute of Technology", "MIT"]
CAMBRIDGE = ["University of Cambridge", "Cambridge University"]

# (names, with outline, image fields, expectation)
CASES = [
    (NAMES, 1, {**INSIDE, **CATEGORY, "title": "File:Korea University main hall.jpg"}, {"tier": "verified", "confidence": 100, "category": "campus", "highlight": True}),
    (NAMES, 1, {**CATEGORY, "title": "File:Korea University gate.jpg"}, {"tier": "likely"}),
    (NAMES, 1, {**CATEGORY, "lat": 37.513, "lng": 127.009, "date_taken": "1971"}, {"tier": "unconfirmed", "category": "campus", "geo": -30}),
    (NAMES, 1, {"lat": 37.5955, "lng": 127.032, "title": "File:Anam street cafe.jpg"}, {"category": "city", "tag": "student_life", "geo": 12}),
    (NAMES, 1, {"lat": 37.5955, "lng": 127.032, "matched_category": "Registered heritages in Korea University", "matched_subcategory": True,
                "title": "File:Korea University 0a.jpg"}, {"tier": "verified", "category": "campus"}),
    (NAMES, 0, {"lat": 37.5895, "lng": 127.0325}, {"geo": 20}),
    (NAMES, 0, {**CATEGORY, "lat": 37.600, "lng": 127.032}, {"geo": 6, "category": "campus", "tier": "likely"}),
    (NAMES, 0, {"lat": 37.62, "lng": 127.10}, {"geo": -10, "category": "city"}),
    (NAMES, 0, {**CATEGORY, "lat": 37.62, "lng": 127.10}, {"category": "campus"}),
    (NAMES, 1, {}, {"tier": "unconfirmed", "category": "campus"}),
    (NAMES, 1, CATEGORY, {"tier": "unconfirmed"}),
    (NAMES, 1, {"title": "File:Korea University.jpg"}, {"tier": "unconfirmed", "text": 14}),
    (NAMES, 1, {"source": "official_site", "source_domain": "www.korea.ac.kr", "title": "Campus"}, {"tier": "likely", "text": 30}),
    (NAMES, 1, {"source_domain": "www.korea.ac.kr", "title": "Korea University campus 2025", "license": None}, {"tier": "likely"}),
    (NAMES, 1, {"source_domain": "example.com", "title": "Korea University campus 2025", "license": None}, {"tier": "unconfirmed"}),
    (NAMES, 1, {"title": "File:2006고려대학교19.jpg"}, {"text": 14}),
    (NAMES, 1, {"title": "File:KUMC hospital view.jpg"}, {"text": 0}),
    (NAMES, 1, {"title": "File:kudos.jpg"}, {"text": 0}),
    (NAMES, 1, {"title": "File:KU Main Building.jpg"}, {"text": 14}),
    (NAMES, 1, {**INSIDE, **CATEGORY, "title": "File:Korea University conference hall.jpg"}, {"content": 0}),
    (NAMES, 1, {**INSIDE, **CATEGORY, "title": "File:Korea University main hall.jpg", "vision_checked": False}, {"tier": "likely", "confidence": 79}),
    (NAMES, 1, {**IN_LIBRARY, "title": "File:IMG 2041.jpg"}, {"category": "libraries"}),
    (NAMES, 1, {"matched_category": "Korea University Library", "matched_subcategory": True, "title": "File:Korea University lecture.jpg"},
     {"category": "libraries"}),
    (NAMES, 1, {"title": "File:고려대학교 중앙도서관.jpg"}, {"category": "libraries"}),
    (NAMES, 1, {"description": "고려대학교 세종학술정보원"}, {"category": "libraries"}),
    (NAMES, 1, {"title": "File:Student dormitory.jpg"}, {"category": "dorms"}),
    (NAMES, 1, {"title": "File:Lecture room 101.jpg"}, {"category": "classrooms"}),
    (NAMES, 1, {"title": "File:Renewable Energy Laboratory.jpg"}, {"tag": "labs", "content": 0}),
    (NAMES, 1, {"title": "File:RAs at Nazarbayev University.jpg", "description": "three research assistants in laboratory"}, {"no_tag": "labs"}),
    (NAMES, 1, {**INSIDE, **CATEGORY, "title": "File:Pizza at Korea University cafeteria.jpg"}, {"tier": "unconfirmed", "content": -15}),
    (NAMES, 1, {**STREET, "vision_label": "not_campus_place", "vision_weight": -20, "vision_veto": True, **CATEGORY,
                "description": "Main building of Korea University"}, {"tier": "unconfirmed"}),
    (NAMES, 1, {**INSIDE, **CATEGORY, "description": "Main building of Korea University", "vision_label": "not_campus_place", "vision_weight": -20},
     {"tier": "verified"}),
    (NAMES, 1, {**INSIDE, "title": "File:고려대학교 의과대학.jpg", **CATEGORY, "source_categories": ["Korea University Medical Center"]}, {"content": 0}),
    (["Hospital University of Somewhere"], 1, {**INSIDE, "title": "File:Main gate.jpg", "matched_category": "Hospital University of Somewhere"},
     {"content": 0}),
]


def titled(names, fields, wanted, titles):
    CASES.extend((names, 1, {**fields, "title": f"File:{t}.jpg"}, wanted) for t in titles)


def filed_under(names, fields, wanted, categories):
    CASES.extend((names, 1, {**fields, "title": "File:Yard 7.jpg", "source_categories": [c]}, wanted) for c in categories)


EVENT, PLACE = {"tier": "unconfirmed", "content": -15}, {"content": 0}
# Another institution: by the title, by the matched category, by any category, but not where it bears the own name.
titled(NAMES, {**INSIDE, **CATEGORY}, {"tier": "unconfirmed", "content": -20}, ["Kindergarten playground", "Clinic ward 3", "Лицей номер 5", "세브란스 병원"])
CASES.append((CAMBRIDGE, 1, {**INSIDE, "title": "File:Corridor.jpg", "matched_category": "Addenbrooke clinic"}, {"content": -20}))
filed_under(CAMBRIDGE, {**INSIDE, "matched_category": "University of Cambridge"}, {"content": -20}, ["Primary schools by county"])
# Printed and drawn things are dropped by title, whatever the language, and by the collection they are in.
titled(NAMES, {}, None, ["Crest and coat of arms", "Old lithograph", "Banknote of 1950", "Газета за май", "우표 1970", "Zertifikat 4", "TEM scans of iron", "Statistics of 2011"])
filed_under(NAMES, {}, None, ["Seals of cities", "Confocal microscopy", "Coats of arms of towns", "Maps of Asia"])
CASES.append((NAMES, 1, {"title": "File:Leaf.jpg", "description": "Seen under a strong microscope"}, None))
# People and occasions, one way of saying it for each family of words.
titled(MIT, INSIDE, EVENT, ["Protestors by the fountain", "Strikers at noon", "She delivered the keynote", "Marching through rain", "Mayor shakes hands", "Vigil at dusk",
                            "Two chemists", "Boys at the pond", "Рукопожатие", "На демонстрацию", "졸업식", "Huelga de mayo", "Discours du soir", "Rede des Kanzlers"])
filed_under(MIT, INSIDE, EVENT, ["Rallies in Boston", "Engineers at work", "Portraits of deans", "1901 births", "Singers of Wales"])
# The same nouns in front of a place's name are a place; in front of something else they aren't.
for noun, place, thing in [("conference", "room", "dinner"), ("meeting", "point", "notes"), ("speech", "lab", "notes"), ("rally", "house", "notes"),
                           ("demonstration", "site", "notes"), ("police", "box", "garden")]:
    titled(MIT, INSIDE, PLACE, [f"{noun} {place}"])
    titled(MIT, INSIDE, EVENT, [f"{noun} {thing}"])
titled(MIT, INSIDE, PLACE, ["Striking facade", "Position of the tower", "March sunrise", "Министерства", "경찰서 앞", "Демонстрационный зал"])
# What is looked at closely is no view; the room for it is one.
titled(NAMES, IN_LIBRARY, EVENT, ["Bacterium colony", "Crystals of salt", "Пробирка", "Synthesis of a dye"])
titled(NAMES, INSIDE, PLACE, ["Microscopy core", "Crystal hall", "Photosynthesis garden"])


@pytest.fixture(scope="module")
def scored(spark):
    """All cases in one job: each (names, outline) combination is its own profile."""
    profiles = {}
    for names, outlined, _, _ in CASES:
        profiles.setdefault((tuple(names), outlined), len(profiles) + 1)
    rows = [{**fields, "seq": i, "id": f"c{i}", "profile_id": profiles[tuple(names), outlined]}
            for i, (names, outlined, fields, _) in enumerate(CASES)]
    places = None
    for (names, outlined), number in profiles.items():
        one = campus(spark, list(names), RING if outlined else None, number)
        places = one if places is None else places.unionByName(one)
    houses = buildings(spark)
    everywhere = houses.drop("profile_id").join(spark.createDataFrame([(n,) for n in profiles.values()], "profile_id bigint"))
    result = evidence.score(images(spark, rows), places, everywhere.select(houses.columns))
    return {r["id"]: r for r in result.collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_case(scored, number):
    expected, row = CASES[number][3], scored.get(f"c{number}")
    if expected is None:
        assert row is None
        return
    assert row is not None
    sums = {}
    for e in row["evidence"]:
        sums[e["type"]] = sums.get(e["type"], 0) + e["weight"]
    for key, value in expected.items():
        if key in ("geo", "text", "content"):
            assert sums.get(key, 0) == value
        elif key == "tag":
            assert value in row["tags"]
        elif key == "no_tag":
            assert value not in row["tags"]
        else:
            assert row[key] == value


def test_labels_follow_the_language(spark):
    row = evidence.score(images(spark, [INSIDE]), campus(spark), lang="ru").first()
    assert row["evidence"][0]["label"].startswith("Точка съёмки внутри")


def test_model_evidence_alone_stays_unconfirmed(spark):
    given = F.array(F.struct(F.lit("vision").alias("type"), F.lit("x").alias("label"), F.lit(40).alias("weight")))
    row = spark.range(1).select(evidence.confidence_of(given).alias("c")).select("c", evidence.tier_of(F.col("c")).alias("t")).first()
    assert tuple(row) == (59, "unconfirmed")


def test_no_python_and_no_nested_loop_on_the_scoring_path(spark):
    plan = evidence.score(images(spark, [INSIDE]), campus(spark), buildings(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_text_goes_through_an_exchange(spark):
    """Above the step that reads the texts, rows carry flags: no exchange but a broadcast has a description or a category list below it."""
    plan = evidence.score(images(spark, [INSIDE]), campus(spark), buildings(spark))._jdf.queryExecution().optimizedPlan()

    def wide(node):
        names = {a.split("#")[0] for a in node.output().mkString("|").split("|")}
        return bool(names & {"description", "source_categories", "_own", "_all", "_norm"})

    def joins(node):
        found = [node] if node.nodeName() == "Join" else []
        for i in range(node.children().size()):
            found += joins(node.children().apply(i))
        return found
    found = joins(plan)
    texts = [j for j in found if wide(j.left())]
    assert len(found) >= 3 and len(texts) <= 1


def test_a_decomposed_name_is_the_same_name(spark):
    rows = [{"title": unicodedata.normalize(form, "File:고려대학교 정문.jpg")} for form in ("NFC", "NFD")]
    one, two = evidence.score(images(spark, rows), campus(spark)).select("confidence").collect()
    assert one == two and one["confidence"] > evidence.score(images(spark, [{"title": "File:정문.jpg"}]), campus(spark)).first()["confidence"]


def test_the_institution_found_is_named_in_any_alphabet(spark):
    found = evidence.other_institution(F.array(F.lit("Korea University"))).alias("found")
    rows = images(spark, [{"title": "Городская Больница"}, {"title": "CITY HOSPITAL"}, {"title": "안산병원"}])
    assert [r["found"] for r in rows.orderBy("seq").select(found).collect()] == ["Больниц", "HOSPITAL", "병원"]


def test_prompt_margins(spark):
    def row(good, bad, slot=0):
        values = [0.0] * 9
        values[slot], values[4] = good, bad
        return (values,)
    rows = [row(0.25, 0.265), row(0.265, 0.25), row(0.25, 0.29), row(0.25, 0.32), row(0.30, 0.25, 1), row(0.30, 0.25, 0)]
    got = spark.createDataFrame(rows, "s array<double>").select(verdicts.prompt_verdict(F.col("s")).alias("v")).collect()
    assert [(r.v.label, r.v.weight, r.v.category, r.v.veto) for r in got] == [
        ("inconclusive", 0, None, False), ("inconclusive", 0, None, False), ("not_campus_place", -20, None, False),
        ("not_campus_place", -20, None, True), ("campus_place", 12, "libraries", False), ("campus_place", 12, None, False)]


def test_review_verdicts_lift_and_veto(spark):
    def answer(label, sure, category="campus", highlight="false"):
        return f'{{"label": "{label}", "confidence": {sure}, "category": "{category}", "highlight": {highlight}}}'
    answers = [answer("campus_place", 90, highlight="true"), answer("campus_place", 50), answer("people_or_event", 95),
               answer("not_a_photo", 95), answer("building_interior", 90, "libraries")]
    rows = images(spark, [{**STREET, "vision_checked": False} for _ in answers])
    given = spark.createDataFrame(list(enumerate(answers)), "seq bigint, answer string")
    checked = verdicts.apply_verdict(rows.join(given, "seq").withColumn("verdict", verdicts.review_verdict(F.col("answer"))).drop("answer"))
    got = {r["seq"]: r for r in evidence.score(checked, campus(spark)).collect()}
    assert [got[i]["confidence"] for i in range(5)] == [40 + 28 + 16, 68, 48, 48, 84]
    assert got[0]["highlight"] and not got[1]["highlight"]
    assert got[3]["vision_veto"] and got[3]["tier"] == "unconfirmed" and not got[2]["vision_veto"]
    assert got[4]["category"] == "libraries"


def test_review_candidates_share_slots_between_sources(spark):
    rows = [{**STREET, "source": s} for s in ["web_search"] * 6 + ["mapillary"] * 6] + [{"title": "Central Asia"}]
    photos = cut_lineage(evidence.score(images(spark, rows), campus(spark)))
    picked = ranking.round_robin(ranking.review_candidates(photos), "source", [-F.col("confidence")], 4).collect()
    assert sorted(r["source"] for r in picked) == ["mapillary"] * 2 + ["web_search"] * 2
