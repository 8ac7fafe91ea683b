"""Blocked scans, grouping and near pairs against plain computations on random data with a hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeproof.operators import dedupe, events, ranking, spend
from placeproof.operators.skew import ordered_position, previous_row, running_before


def _rows(spark, n=600, seed=5):
    rng = random.Random(seed)
    rows = [(1 if rng.random() < 0.5 else rng.randrange(2, 9), i * 3 + rng.randrange(3), rng.randrange(4), rng.randrange(50)) for i in range(n)]
    return spark.createDataFrame(rows, "k bigint, seq bigint, a int, v bigint").repartition(4).cache()


def test_blocked_scans_equal_plain_windows(spark):
    rows = _rows(spark)
    by_seq = Window.partitionBy("k").orderBy("seq")
    before = by_seq.rowsBetween(Window.unboundedPreceding, -1)
    want = {r["seq"]: (r["p"], r["s"], r["m"], r["l"]) for r in rows.select(
        "seq", F.row_number().over(Window.partitionBy("k").orderBy("a", "seq")).alias("p"), F.sum("v").over(before).alias("s"),
        F.min("v").over(before).alias("m"), F.lag("v").over(by_seq).alias("l")).collect()}
    def check(df, column, place):
        assert {r["seq"]: r[column] for r in df.select("seq", column).collect()} == {k: v[place] for k, v in want.items()}

    for block in (7, 100):
        check(ordered_position(rows, ["k"], [F.col("a")], "seq", "p", block), "p", 0)
        check(running_before(rows, ["k"], "seq", {"s": F.col("v")}, "sum", block), "s", 1)
        check(running_before(rows, ["k"], "seq", {"m": F.col("v")}, "min", block), "m", 2)
        check(previous_row(rows, ["k"], "seq", {"l": "v"}, block), "l", 3)


def test_version_changed_in_blocks(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbbaacc")], "id bigint, seq bigint, v string")
    for block in (2, 1000):
        got = events.version_changed(rows, ["id"], ["v"], "seq", block).select("seq").collect()
        assert sorted(r[0] for r in got) == [0, 2, 5, 7]


def test_admission_equals_one_by_one_booking(spark):
    rng = random.Random(3)
    rows = [(f"2024-01-0{rng.randrange(1, 3)}", rng.randrange(4), i, "small", rng.randrange(100), rng.randrange(30), rng.randrange(2)) for i in range(300)]
    usage = spark.createDataFrame(
        rows, "day string, user_id int, seq bigint, model string, input_tokens bigint, output_tokens bigint, web_searches int")
    user_cap, day_cap = 90_000, 250_000
    spent, total, want = {}, {}, {}
    for day, user, seq, _, tokens_in, tokens_out, searches in rows:
        want[seq] = spent.get((day, user), 0) < user_cap and total.get(day, 0) < day_cap
        if want[seq]:
            cost = tokens_in + tokens_out * 5 + searches * 10_000
            spent[day, user] = spent.get((day, user), 0) + cost
            total[day] = total.get(day, 0) + cost
    got = spend.spend_admission(usage, user_cap, day_cap, block_rows=16).select("seq", "admitted").collect()
    assert {r["seq"]: r["admitted"] for r in got} == want and 0 < sum(want.values()) < 300


def _photos(seed, n=300):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(40)]
    photos = []
    for i in range(n):
        sig = None
        if rng.random() < 0.8:
            sig = rng.choice(bases)
            for bit in rng.sample(range(64), rng.randrange(0, 13)):
                sig ^= 1 << bit
            sig = sig - (1 << 64) if sig >= 1 << 63 else sig
        sha = "hot" if rng.random() < 0.3 else f"s{rng.randrange(150)}"
        photos.append((rng.randrange(2), i, rng.choice("ab"), f"Title {rng.randrange(120)}", sha, sig))
    return photos


def _close(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 6


def test_grouping_equals_arrival_order_placement(spark):
    for seed in (1, 2):
        photos = _photos(seed)
        groups, want = {}, {}
        for profile, seq, source, title, sha, sig in photos:
            match = [g for g, members in groups.items() if any(
                m[0] == profile and (m[4] == sha or (m[2], m[3]) == (source, title) or (
                    sig is not None and m[5] is not None and _close(sig, m[5]))) for m in members)]
            home = min(match, default=seq)
            groups.setdefault(home, []).append((profile, seq, source, title, sha, sig))
            want[seq] = home
        rows = spark.createDataFrame(photos, "profile_id bigint, seq bigint, source string, title string, sha1 string, sig bigint")
        got = dedupe.group_duplicates(rows, block_rows=32).collect()
        assert {r["seq"]: r["group_seq"] for r in got} == want


def test_near_signatures_equal_all_pairs(spark):
    photos = [p for p in _photos(9) if p[5] is not None]
    rows = spark.createDataFrame(photos, "profile_id bigint, seq bigint, source string, title string, sha1 string, sig bigint")
    distinct = sorted({(p[0], p[5]) for p in photos})
    want = {(p, a, b) for p, a in distinct for q, b in distinct if p == q and a < b and _close(a, b)}
    for spare in (1, 2, 3):
        got = [tuple(r) for r in dedupe.near_signatures(rows, spare=spare).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_exact_links_grow_with_the_rows_not_their_pairs(spark):
    rows = spark.range(500).select(
        F.lit(1).cast("bigint").alias("profile_id"), F.col("id").alias("seq"), F.lit("a").alias("source"), F.lit("").alias("title"),
        F.lit("same").alias("sha1"), F.lit(None).cast("bigint").alias("sig"))
    assert dedupe.exact_links(rows, block_rows=64).count() == 499


def test_camera_titles_and_other_sources_do_not_match(spark):
    rows = spark.createDataFrame([
        (1, 0, "w", "File:Campus view.jpg", "a", None), (1, 1, "w", "File:Campus view (cropped).jpg", "b", None),
        (1, 2, "f", "Campus view", None, None), (1, 3, "f", "IMG_1234", None, None), (1, 4, "f", "IMG_1234", None, None)],
        "profile_id bigint, seq bigint, source string, title string, sha1 string, sig bigint")
    got = dedupe.group_duplicates(rows).collect()
    assert {r["seq"]: r["group_seq"] for r in got} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def _photo_table(spark, rows):
    columns = """profile_id bigint, seq bigint, id string, category string, confidence int, tier string, freshness string, highlight boolean,
        source_url string, source_domain string"""
    return spark.createDataFrame(rows, columns)


def _spaced(photos, order=("campus", "dorms", "classrooms", "libraries", "city")):
    """The page rule said plainly over ranked reliable photos."""
    ranked = sorted(photos, key=lambda p: (-(p["tier"] != "unconfirmed"), -p["confidence"], p["seq"]))
    good = [p for p in ranked if p["tier"] != "unconfirmed"]
    shown = []
    for p in good:
        if p["highlight"] and len(shown) < 4 and all(p["source_url"] != s["source_url"] for s in shown):
            shown.append(p)
    queues = [[p for p in good if p["category"] == c and p not in shown] for c in order]
    out = list(shown)
    while any(queues):
        for q in queues:
            if q:
                last = out[-1]["source_url"] if out else None
                out.append(q.pop(next((i for i, p in enumerate(q) if p["source_url"] != last), 0)))
    return [p["seq"] for p in out + [p for p in ranked if p["tier"] == "unconfirmed"]]


def test_showcase_order_spaces_source_pages(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        profile = rng.choice([1, 1, 2, 3])
        page = f"https://p/{rng.choice([0, 0, 1, 2, 3]) if profile < 3 else i}"
        rows.append((profile, i, f"p{i}", rng.choice(["campus", "campus", "dorms", "city"]), rng.randrange(40, 99),
                     rng.choice(["verified", "likely", "unconfirmed"]), "older", rng.random() < 0.05, page, "x"))
    photos = _photo_table(spark, rows)
    got = ranking.showcase_order(photos, block_rows=32).select("profile_id", "seq", "place").collect()
    for profile in (1, 2, 3):
        mine = [r.asDict() for r in photos.collect() if r["profile_id"] == profile]
        placed = sorted((r["place"], r["seq"]) for r in got if r["profile_id"] == profile)
        assert [p for p, _ in placed] == list(range(1, len(mine) + 1))
        assert [s for _, s in placed] == _spaced(mine)


def test_diverse_top_picks_the_least_alike(spark):
    rows = spark.createDataFrame([
        (1, "campus", 0, "likely", 70, "older", [1.0, 0.0]), (1, "campus", 1, "likely", 70, "older", [0.9, 0.1]),
        (1, "campus", 2, "likely", 70, "older", [0.0, 1.0]), (1, "campus", 3, "likely", 90, "older", [1.0, 0.0]),
        (1, "campus", 4, "likely", 70, "older", None)],
        "profile_id bigint, category string, seq bigint, tier string, confidence int, freshness string, embedding array<double>")
    got = {r["pick"]: r["seq"] for r in ranking.diverse_top(rows, 3).collect()}
    assert got == {1: 3, 2: 2, 3: 4}


def test_targets_keep_unconfirmed_photos(spark):
    rows = [(1, i, f"r{i}", "campus", 90, "verified", "older", False, f"u{i}", "x") for i in range(4)]
    rows += [(1, 10 + i, f"w{i}", "campus", 50, "unconfirmed", "older", False, f"v{i}", "x") for i in range(3)]
    kept = ranking.select_targets(_photo_table(spark, rows), {"campus": 2})
    assert sorted(r["tier"] for r in kept.collect()) == ["unconfirmed"] * 3 + ["verified"] * 2
    parsed = spark.range(1).select(ranking.parse_targets(F.lit("campus=12, dorms=6,bad,city=x")).alias("t")).first()["t"]
    assert parsed == {"campus": 12, "dorms": 6}


def test_block_keys_meet_by_shuffle(spark):
    """A signature becomes 84 rows, which no size estimate counts: a broadcast of them would go through the driver."""
    rows = spark.createDataFrame([(1, i, i) for i in range(20)], "profile_id bigint, seq bigint, sig bigint")
    near = dedupe.near_signatures(rows)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert near.count() == sum(bin(a ^ b).count("1") <= 6 for a in range(20) for b in range(a))


def test_cells_are_judged_without_moving_outlines_for_their_levels(spark):
    """Levels need one pass over the rings; the rows of a building's cells carry no outline."""
    from placeproof.operators import spatial
    from tests.helpers import buildings
    sized, whole, _ = spatial._by_cell(buildings(spark), spatial.CELL_DEG)
    assert "Repartition" not in sized._jdf.queryExecution().optimizedPlan().toString()
    above = whole._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "edges" not in above and "zip_with" not in above
