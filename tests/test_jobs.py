"""Sources, resolution, storage and streams end to end on small inputs."""

import datetime
import json
import random

import pytest
from helpers import INSIDE, LIBRARY, RING, buildings, campus, images
from pyspark.sql import functions as F

from placeproof import schemas
from placeproof.functions.text import name_similarity
from placeproof.operators import evidence, resolve, spatial, verdicts
from placeproof.sources import images as sources
from placeproof.sources import maps, site, store
from placeproof.streaming import jobs

HIT = "query_id bigint, ord bigint, name string, aliases array<string>, city string, wikidata_ids array<string>, sitelinks int"


def _today():
    return F.lit("2026-09-18").cast("date")


def _hits(spark, rows):
    return schemas.conform(spark.createDataFrame(rows, HIT), schemas.REGISTRY_HITS)


def test_resolution_decisions(spark):
    left = _hits(spark, [
        (1, 0, "Korea University", [], "Seoul", ["Q39997"], 0), (1, 1, "Korea University", [], "Tokyo", [], 0),
        (2, 0, "University of Cambridge", ["Cambridge"], "Cambridge", ["Q35794"], 0), (3, 0, "Cockcroft Institute", [], "Daresbury", [], 0)])
    right = _hits(spark, [
        (1, 0, "Korea University", [], "Seoul", ["Q39997"], 60), (2, 0, "University of Cambridge", ["Cambridge"], "Cambridge", ["Q35794"], 200)])
    queries = spark.createDataFrame(
        [(1, "Korea University", None), (2, "Cambridge", None), (3, "Xyzzqq Blorft Institute", None), (4, "Nobody", None)],
        "query_id bigint, query string, corrected_query string")
    merged = resolve.merge_registries(left, right)
    assert merged.filter("query_id = 1").count() == 2 and merged.filter("left is not null and right is not null").count() == 2
    scored = resolve.score_candidates(merged, queries)
    status = {r["query_id"]: r["status"] for r in resolve.decide(scored, queries).collect()}
    assert status == {1: "resolved", 2: "ambiguous", 3: "not_found", 4: "not_found"}
    best = resolve.to_candidate(resolve.top_candidates(scored)).filter("query_id = 1 and position = 1").first()
    assert (best["city"], best["id"]) == ("Seoul", "Q39997")


def test_right_hits_take_the_first_free_left_hit(spark):
    left = _hits(spark, [(1, i, f"L{i}", [], None, ["Q1"], 0) for i in range(2)])
    right = _hits(spark, [(1, i, f"R{i}", [], None, ["Q1"], 0) for i in range(3)])
    got = resolve.merge_registries(left, right).select("left.name", "right.name").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("L0", "R0"), ("L1", "R1"), (None, "R2")]))


def _payloads(spark, items):
    return spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(items)], "profile_id bigint, seq bigint, payload string")


def test_media_pages_and_web_items(spark):
    page = {"pageid": 5, "title": "File:Hall.jpg", "coordinates": [{"lat": 1.0, "lon": 2.0}], "imageinfo": [{
        "url": "u", "mime": "image/jpeg", "sha1": "s", "timestamp": "2024-01-02T03:04:05Z", "width": 800, "height": 600, "extmetadata": {
            "Artist": {"value": "—"}, "DateTimeOriginal": {"value": "<time>2019-05-06</time>"}, "Categories": {"value": "A|B"}}}]}
    small = {**page, "pageid": 6, "imageinfo": [{**page["imageinfo"][0], "height": 100}]}
    got = sources.normalize_commons(_payloads(spark, [page, small]), _today()).collect()
    assert [(r["id"], r["date_taken"], r["date_source"], r["author"], r["source_categories"]) for r in got] == [
        ("commons-5", "2019-05-06", "source_metadata", None, ["A", "B"])]
    item = {"title": "t", "url": "https://www.site.org/a", "thumbnail": {"src": "https://t/1"}, "properties": {"url": "https://i/1", "width": 800, "height": 600}}
    got = sources.normalize_web_search(_payloads(spark, [item, {**item, "url": "https://other.org/b"}, {**item, "url": "ftp://x"}])).collect()
    assert len(got) == 2 and got[0]["id"] == got[1]["id"] and got[0]["source_domain"] == "www.site.org"


def test_page_images_and_site_maps(spark):
    html = """<title>Our campus</title><meta property="og:image" content="/img/a_b.jpg"><meta property="og:image" content="/logo.svg">
        <meta name="twitter:image" content="/img/a_b.jpg"><img src="/lib.jpg" alt="The library hall"><img src="/x.jpg" alt="short">
        <script type="application/ld+json">{"@graph": [{"@type": "ImageObject", "contentUrl": "/lib.jpg", "dateCreated": "2020-05"}]}</script>"""
    pages = spark.createDataFrame([(1, 1, "https://www.u.edu/en", html), (1, 2, "https://www.u.edu/two", html)],
                                  "profile_id bigint, seq bigint, url string, html string")
    got = {r["full_url"]: r for r in site.extract_page_images(pages, _today()).collect()}
    assert set(got) == {"https://www.u.edu/img/a_b.jpg", "https://www.u.edu/lib.jpg"}
    assert got["https://www.u.edu/lib.jpg"]["date_taken"] == "2020-05" and got["https://www.u.edu/img/a_b.jpg"]["title"] == "Our campus a b.jpg"
    assert all(r["source_url"].endswith("/en") for r in got.values())
    xml = "<urlset><url><loc>https://u/campus/a</loc><lastmod>2020</lastmod></url><url><loc>https://u/news</loc></url><url><loc>https://u/campus/b</loc><lastmod>2024</lastmod></url></urlset>"
    links = site.sitemap_links(spark.createDataFrame([(1, xml)], "site_id int, xml string")).orderBy("position").collect()
    assert [r["link"] for r in links] == ["https://u/campus/b", "https://u/campus/a"]


def _way(number, tags, x0, y0, x1, y1):
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return {"type": "way", "id": number, "tags": tags, "geometry": [{"lon": x, "lat": y} for x, y in corners]}


def test_map_buildings_and_campus_choice(spark):
    elements = maps.read_elements(_payloads(spark, [
        _way(1, {"building": "university", "name": "Main", "height": "22.5 m", "building:levels": "5"}, 0.002, 0.002, 0.003, 0.003),
        _way(2, {"building": "yes"}, 0.0104, 0.005, 0.0105, 0.0051), _way(3, {"building": "yes"}, 0.05, 0.05, 0.051, 0.051),
        _way(4, {"highway": "path"}, 0.002, 0.002, 0.003, 0.003), _way(5, {"amenity": "library"}, 0.004, 0.004, 0.005, 0.005),
        _way(9, {"amenity": "college"}, -5.0, -5.0, 5.0, 5.0),
        {"type": "relation", "id": 7, "tags": {"amenity": "university", "wikidata": "Q1", "name": "U"}, "members": [
            {"type": "way", "role": "", "geometry": _way(0, {}, 0.0, 0.0, 0.01, 0.01)["geometry"]}]}]))
    universities = spark.createDataFrame([(1, "Q1", ["U"], 0.005, 0.005)], "profile_id bigint, entity_id string, names array<string>, lat double, lng double")
    chosen = spatial.pick_campus(maps.campus_elements(elements), universities, name_similarity)
    assert [(r["element_id"], r["rank"]) for r in chosen.collect()] == [(7, 0)]
    outline = chosen.select("profile_id", "ring", F.lit(0.005).alias("lat"), F.lit(0.005).alias("lng"))
    near = {r["building_id"]: r for r in spatial.buildings_near_campus(maps.normalize_buildings(elements), outline).collect()}
    assert set(near) == {"way-1", "way-2", "way-5"}
    assert (near["way-1"]["type"], near["way-1"]["height_m"], near["way-1"]["levels"], near["way-1"]["inside_campus"]) == ("academic", 22.5, 5, True)
    assert not near["way-2"]["inside_campus"] and near["way-5"]["type"] == "library"


def test_profiles_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "profiles")
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "profile_id bigint, seq bigint, v string")
    store.write_profile(rows, path, "en")
    store.write_profile(rows.filter("profile_id = 1").withColumn("v", F.lit("new")), path, "en")
    assert sorted((r["profile_id"], r["v"]) for r in store.read_profile(spark, path, "en").collect()) == [(1, "new"), (2, "b")]
    assert store.read_profile(spark, path, "en", 2).count() == 1


def test_changes_over_several_batches(spark, tmp_path):
    schema = "id string, seq bigint, v int"
    log, changes = str(tmp_path / "log"), jobs.Changes(spark, str(tmp_path), schema, "id", ["v"])
    for batch in ([("a", 1, 1), ("b", 2, 1), ("a", 3, 1)], [("a", 4, 2), ("b", 5, 1)], [("a", 6, 2), ("a", 7, 1)], [("a", 2, 9)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(log)
        jobs.run_available(jobs.follow(spark, log, schema), changes.add, str(tmp_path / "cp"))
    # The late row a2 is a change, and so is a3 behind it.
    assert sorted((r["id"], r["seq"]) for r in changes.current().collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 7), ("b", 2)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    changes = jobs.Changes(spark, str(tmp_path), "id string, seq bigint, v int", "id", ["v"])
    for number, batch in ((0, [("a", 1, 1)]), (1, [("a", 2, 1), ("a", 3, 2)]), (1, [("a", 2, 1), ("a", 3, 2)]), (2, [("a", 3, 2), ("a", 1, 1)])):
        changes.add(spark.createDataFrame(batch, "id string, seq bigint, v int"), number)
    assert sorted(r["seq"] for r in changes.current().collect()) == [1, 3]


@pytest.mark.parametrize("expires", [None, ("at", 30)])
def test_shuffled_arrivals_give_the_changes_of_one_batch(spark, tmp_path, expires):
    """A hot key with many blocks, a key in one block, and gaps of several empty blocks; arrivals in random order."""
    rng = random.Random(7)
    start = datetime.datetime(2026, 1, 1)
    rows = [("hot" if rng.random() < 0.7 else "cold", seq, rng.randrange(2), start + datetime.timedelta(seconds=17 * i))
            for i, seq in enumerate([*range(40), *range(90, 110), 300])]
    last, want = {}, []
    for key, seq, v, at in rows:
        before = last.get(key)
        if before is None or before[0] != v or (expires and (at - before[1]).total_seconds() > 30):
            want.append((key, seq))
        last[key] = (v, at)
    rng.shuffle(rows)
    changes = jobs.Changes(spark, str(tmp_path), "id string, seq bigint, v int, at timestamp", "id", ["v"], expires, block_rows=4)
    for number, begin in enumerate(range(0, len(rows), 16)):
        changes.add(spark.createDataFrame(rows[begin:begin + 16], "id string, seq bigint, v int, at timestamp"), number)
    assert sorted((r["id"], r["seq"]) for r in changes.current().collect()) == sorted(want)


def test_late_spend_counts_on_its_day(spark, tmp_path):
    budget = jobs.DailyBudget(spark, str(tmp_path))
    call = "ts timestamp, user_id bigint, model string, input_tokens bigint, output_tokens bigint, web_searches bigint"
    day = lambda d: datetime.datetime(2026, 1, d, 12)
    for number, d in enumerate((9, 1, 9)):
        budget.add(spark.createDataFrame([(day(d), 1, "small", 1000, 1000, 1)], call), number)
    spent = {r["day"].day: r["spent"] for r in budget.total().collect()}
    assert set(spent) == {1, 9} and spent[9] == 2 * spent[1]


def _verdict():
    return F.struct(F.lit("not_campus_place").alias("label"), F.lit(-20).alias("weight"), F.lit(True).alias("veto"), F.lit(None).cast(
        "string").alias("category"), F.lit(False).alias("highlight"), F.lit("review").alias("source"))


def test_late_outline_and_verdict_change_a_photo_once(spark, tmp_path):
    build = jobs.ProfileBuild(spark, str(tmp_path), schemas.RAW_IMAGES, schemas.CAMPUS, buildings(spark))
    rows = images(spark, [{**INSIDE, "vision_checked": False}, {"title": "File:logo.png"}])
    build.campus.write(campus(spark, ring=None), "points")
    build.add_images(rows, 1)
    assert [r["confidence"] for r in build.current().collect()] == [60]
    build.add_images(rows, 2)
    build.add_campus(campus(spark), 3)
    build.add_verdicts(rows.limit(1).select("profile_id", "id", _verdict().alias("verdict")), 4)
    build.add_images(images(spark, [{**INSIDE, "title": "File:poster.jpg"}]), 5)
    history = {r["batch"]: (r["confidence"], r["removed"]) for r in build.photos.rows().collect()}
    assert history == {"images-1": (60, False), "campus-3": (68, False), "verdicts-4": (48, False), "images-5": (None, True)}
    assert build.current().count() == 0


@pytest.mark.parametrize("order", ["icv", "vci", "civ", "ivvic"])
def test_inputs_in_any_order_give_the_same_photos(spark, tmp_path, order):
    build = jobs.ProfileBuild(spark, str(tmp_path), schemas.RAW_IMAGES, schemas.CAMPUS, buildings(spark))
    rows = images(spark, [{**INSIDE, "vision_checked": False}, {"title": "File:Korea University gate.jpg"}])
    twice = rows.limit(1).select("profile_id", "id", _verdict().alias("verdict"))
    add = {"i": lambda n: build.add_images(rows, n), "c": lambda n: build.add_campus(campus(spark).union(campus(spark)), n),
           "v": lambda n: build.add_verdicts(twice.union(twice), n)}
    for n, kind in enumerate(order):
        add[kind](n)
    want = evidence.score(verdicts.apply_verdict(rows.join(twice, ["profile_id", "id"], "left")).select(rows.columns), campus(spark), buildings(spark))
    key = lambda df: sorted(tuple(r) for r in df.select("id", "confidence", "tier").collect())
    assert key(build.current()) == key(want)


def test_duplicates_keep_their_groups_as_photos_arrive(spark, tmp_path):
    stream = jobs.DuplicateStream(spark, str(tmp_path))
    for n, batch in enumerate([[(1, 0, "a", "", "x", None), (1, 1, "a", "", "y", None)], [(1, 2, "a", "", "y", None), (2, 3, "a", "", "x", None)]]):
        stream.add(spark.createDataFrame(batch, jobs.DuplicateStream.PHOTO), n)
    assert {r["seq"]: r["group_seq"] for r in stream.current().collect()} == {0: 0, 1: 1, 2: 1, 3: 3}


def _first_match(rows):
    """{(profile, seq): group} by the plain rule: the least group among earlier photos with a common key or a near signature."""
    groups = {}
    for p, seq, _, _, sha1, sig in sorted(rows):
        met = [groups[q, s] for q, s, _, _, other, near in rows if (q, s) in groups and q == p and (
            sha1 and sha1 == other or sig is not None and near is not None and ((sig ^ near) & (1 << 64) - 1).bit_count() <= 6)]
        groups[p, seq] = min([seq, *met])
    return groups


@pytest.mark.parametrize("shuffled", [False, True])
def test_photos_and_signatures_in_any_order_give_the_groups_of_one_batch(spark, tmp_path, shuffled):
    rng = random.Random(3)
    centers = [-1, 0x1234567890ABCDEF, 0]
    rows = []
    for seq in range(60):
        sig = rng.choice(centers)
        for bit in rng.sample(range(63), rng.randrange(7)):
            sig ^= 1 << bit
        rows.append((rng.choice([1, 1, 2]), seq, "a", "", rng.choice(["", "", f"h{rng.randrange(12)}"]), rng.choice([None, sig])))
    order = rng.sample(rows, len(rows)) if shuffled else rows
    stream, later = jobs.DuplicateStream(spark, str(tmp_path)), set(rng.sample(range(60), 10)) if shuffled else set()
    for n in range(2):
        batch = [(*r[:5], None if r[1] in later else r[5]) for r in order[30 * n:30 * n + 30]]
        stream.add(spark.createDataFrame(batch + batch[:2], jobs.DuplicateStream.PHOTO), n)
        if n == 1:
            stream.add(spark.createDataFrame(batch, jobs.DuplicateStream.PHOTO), n)
    if later:
        stream.add_signatures(spark.createDataFrame([(r[0], r[1], r[5]) for r in rows if r[1] in later], "profile_id bigint, seq bigint, sig bigint"), 0)
    assert {(r["profile_id"], r["seq"]): r["group_seq"] for r in stream.current().collect()} == _first_match(rows)
