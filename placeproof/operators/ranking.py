"""Order, selection and diversity of photos. Positions over a whole profile are computed in blocks, never in one window."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.operators.skew import BLOCK_ROWS, ordered_position, previous_row
from placeproof.session import cut_lineage

# Fixed values.
FRESHNESS_BONUS = {"2024_plus": 20, "2020_2023": 10, "older": -5, "date_unknown": -5, "historic": -10}
SHOWCASE_CATEGORIES = ["campus", "dorms", "classrooms", "libraries", "city"]
MAX_HIGHLIGHTS = 4
STREET_LEVEL_DOMAIN = "www.mapillary.com"
REVIEW_LIMIT = 140
MIN_REVIEW_CONFIDENCE = 44


def reliable() -> Column:
    return F.col("tier") != "unconfirmed"


def bonus() -> Column:
    table = F.create_map(*[F.lit(x) for pair in FRESHNESS_BONUS.items() for x in pair])
    return F.element_at(table, F.col("freshness"))


def rank_order() -> list[Column]:
    """Ascending keys of the trust-first order; ties keep `seq`."""
    return [-reliable().cast("int"), -(F.col("confidence") + bonus()), -F.col("confidence")]


def rank_photos(photos: DataFrame) -> DataFrame:
    return photos.orderBy("profile_id", *rank_order(), "seq")


def with_rank(photos: DataFrame, keys: list[str], out: str = "rank", block_rows: int = BLOCK_ROWS) -> DataFrame:
    return ordered_position(photos, keys, rank_order(), "seq", out, block_rows)


def parse_targets(value: Column) -> Column:
    """`a=1, b=2` to a map; parts without a name or a whole number are ignored."""
    parts = F.transform(F.split(value, ","), lambda p: F.struct(
        F.trim(F.substring_index(F.trim(p), "=", 1)).alias("name"),
        F.when(F.contains(p, F.lit("=")), F.trim(F.regexp_replace(F.trim(p), r"^[^=]*=", ""))).alias("count")))
    good = F.filter(parts, lambda p: (p["name"] != "") & F.coalesce(p["count"].rlike(r"^\d+$"), F.lit(False)))
    ordered = F.aggregate(
        good, F.create_map().cast("map<string,int>"), lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, v: k != p["name"]), F.create_map(p["name"], p["count"].cast("int"))))
    return ordered


def select_targets(photos: DataFrame, targets: dict[str, int]) -> DataFrame:
    """The best reliable photos per category up to its target (all without one) and every unconfirmed photo.

    Photos with an `embedding` column are picked for diversity; without one, likeness is unknown and their rank decides.
    """
    if not targets:
        return photos
    capped = reliable() & F.col("category").isin(list(targets))
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]), F.col("category"))
    if "embedding" in photos.columns:
        picked = diverse_top(photos.filter(capped), max(targets.values()))
        return photos.filter(~capped).unionByName(picked.filter(F.col("pick") <= wanted).drop("pick").select(photos.columns))
    best = Window.partitionBy("profile_id", "category").orderBy(*rank_order(), "seq")
    top = photos.filter(capped).withColumn("_n", F.row_number().over(best)).filter(
        F.col("_n") <= max(targets.values())).filter(F.col("_n") <= wanted).drop("_n")
    return photos.filter(~capped).unionByName(top)


def diverse_top(photos: DataFrame, count: int) -> DataFrame:
    """Greedy selection per (profile, category): trust and freshness first, then least like what is already chosen.

    `photos` carry an `embedding` array (null when unknown). Each step is one aggregation that combines map-side and
    a join with at most one chosen row per group, so ties of any size never meet in one task. The result has `pick`.
    """
    keys = ["profile_id", "category"]
    order = F.struct(
        *[c.alias(f"k{i}") for i, c in enumerate(rank_order()[:2])], F.col("likeness").alias("likeness"),
        rank_order()[2].alias("k2"), F.col("seq").alias("seq"))
    pool = photos.select(*keys, "seq", "tier", "confidence", "freshness", "embedding").withColumns(
        {"likeness": F.lit(0.0), "compared": F.lit(False)})
    picks: DataFrame | None = None
    for step in range(1, count + 1):
        chosen = cut_lineage(pool.groupBy(*keys).agg(F.min(F.struct(order.alias("order"), "embedding")).alias("best")).select(
            *keys, F.col("best.order.seq").alias("chosen_seq"), F.col("best.embedding").alias("chosen_embedding")))
        pick = chosen.select(*keys, F.col("chosen_seq").alias("seq"), F.lit(step).alias("pick"))
        picks = pick if picks is None else picks.unionByName(pick)
        if step == count:
            break
        dot = F.aggregate(
            F.zip_with("embedding", "chosen_embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0),
            lambda s, v: s + v)
        known = F.col("embedding").isNotNull() & F.col("chosen_embedding").isNotNull()
        pool = pool.join(chosen, keys).filter(F.col("seq") != F.col("chosen_seq")).withColumn(
            "likeness", F.when(~known, F.col("likeness")).when(F.col("compared"), F.greatest("likeness", dot)).otherwise(dot)
        ).withColumn("compared", F.col("compared") | known).drop("chosen_seq", "chosen_embedding")
        if step % 4 == 0:
            pool = cut_lineage(pool)
    return photos.join(picks, [*keys, "seq"])


def pick_highlights(photos: DataFrame, limit: int = MAX_HIGHLIGHTS) -> DataFrame:
    """Reliable showcase photos, street-level frames last, one per source page, at most `limit` per profile."""
    order = [(F.col("source_domain") == STREET_LEVEL_DOMAIN).cast("int"), *rank_order()]
    named = {f"_k{i}": c for i, c in enumerate(order)}
    shown = photos.filter(F.col("highlight") & reliable()).withColumns(named)
    per_page = shown.groupBy("profile_id", "source_url").agg(F.min(F.struct(*named, "seq")).alias("_best")).select(
        "profile_id", "_best.*")
    top = Window.partitionBy("profile_id").orderBy(*named, "seq")
    picked = per_page.withColumn("highlight_no", F.row_number().over(top)).filter(F.col("highlight_no") <= limit)
    return photos.join(picked.select("profile_id", "seq", "highlight_no"), ["profile_id", "seq"])


def _space_pages(rows: pd.DataFrame) -> pd.DataFrame:
    """Round-robin where the head of a queue waits a turn when it comes from the page just shown.

    A queue is kept as runs of one page, so passing over a long run costs one step.
    """
    queues: dict[tuple, deque] = {}
    for row in rows.sort_values(["turn", "queue"]).itertuples(index=False):
        runs = queues.setdefault((row.queue, row.category), deque())
        if runs and runs[-1][0] == row.page:
            runs[-1][1].append(row.seq)
        else:
            runs.append((row.page, deque([row.seq])))
    order, last = [], rows["opening_page"].iloc[0]
    lines = [queues[key] for key in sorted(queues)]
    while any(lines):
        for runs in filter(None, lines):
            held = runs.popleft() if runs[0][0] == last and len(runs) > 1 else None
            last, members = runs[0]
            order.append(members.popleft())
            if not members:
                runs.popleft()
            if held and runs and runs[0][0] == held[0]:
                held[1].extend(runs.popleft()[1])
            if held:
                runs.appendleft(held)
    return pd.DataFrame({
        "profile_id": rows["profile_id"].iloc[0], "seq": order, "place": range(1, len(order) + 1)})


def showcase_base(photos: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(profile_id, seq, place) without the page rule: highlights, a round-robin over categories, then unconfirmed."""
    highlights = pick_highlights(photos).select("profile_id", "seq", "highlight_no")
    marked = photos.join(highlights, ["profile_id", "seq"], "left")
    queue = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in SHOWCASE_CATEGORIES]), F.col("category")), F.lit(0))
    queued = marked.withColumns({
        "part": F.when(F.col("highlight_no").isNotNull(), 0).when(reliable(), 1).otherwise(2),
        "queue": F.when(queue > 0, queue).otherwise(len(SHOWCASE_CATEGORIES) + 1)})
    turned = with_rank(queued, ["profile_id", "part", "category"], "turn", block_rows)
    ranked = with_rank(turned.filter("part <> 1"), ["profile_id", "part"], "line", block_rows).withColumn(
        "line", F.coalesce(F.col("highlight_no").cast("bigint"), F.col("line")))
    rotated = turned.filter("part = 1").withColumn("line", F.col("turn"))
    return ranked.unionByName(rotated)


def showcase_order(photos: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Photos with `place` in the default view: highlights, rotating categories with source pages spaced out, unconfirmed.

    Only profiles where two neighbours of the plain rotation share a page need the sequential page rule; the others
    keep the rotation computed in blocks. The page rule reads narrow rows: sequence number, category and page hash.
    """
    base = cut_lineage(showcase_base(photos, block_rows)).select(
        "profile_id", "seq", "part", "line", "queue", "category", F.xxhash64("source_url").alias("page"))
    placed = cut_lineage(ordered_position(
        base, ["profile_id"], [F.col("part"), F.floor(F.col("line") / block_rows)], "seq", "place", block_rows,
        inner=[F.col(c) for c in ("line", "queue", "category", "seq")]))
    neighbours = previous_row(placed.select("profile_id", "place", "part", "page"), ["profile_id"], "place", {
        "before": "page"}, block_rows)
    clashing = neighbours.filter((F.col("part") == 1) & (F.col("page") == F.col("before"))).select(
        "profile_id").distinct()
    opening = placed.filter("part = 0").groupBy("profile_id").agg(
        F.max_by("page", "place").alias("opening_page"), F.max("place").alias("opened"))
    rows = placed.filter("part = 1").join(clashing, "profile_id", "left_semi").join(opening, "profile_id", "left")
    spaced = rows.select("profile_id", "seq", "category", "queue", F.col("line").alias("turn"), "page", "opening_page").groupBy(
        "profile_id").applyInPandas(_space_pages, "profile_id bigint, seq bigint, place bigint")
    moved = spaced.join(opening.select("profile_id", "opened"), "profile_id", "left").select(
        "profile_id", "seq", (F.col("place") + F.coalesce("opened", F.lit(0))).alias("spaced"))
    final = placed.select("profile_id", "seq", "place").join(moved, ["profile_id", "seq"], "left").select(
        "profile_id", "seq", F.coalesce("spaced", "place").alias("place"))
    return photos.join(final, ["profile_id", "seq"])


def round_robin(
    rows: DataFrame, part: str, order: list[Column], limit: int | None = None, keys: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fair turns over the parts of each key: best of every part first, parts in order of their own best row.

    With a limit, only each part's first `limit` rows can be chosen, so a bounded window is enough.
    """
    keys = keys or ["profile_id"]
    names = {f"_r{i}": c for i, c in enumerate(order)}
    if limit is None:
        turned = ordered_position(rows.withColumns(names), [*keys, part], [F.col(n) for n in names], "seq", "turn", block_rows)
    else:
        best = Window.partitionBy(*keys, part).orderBy(*names, "seq")
        turned = rows.withColumns(names).withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= limit)
    heads = turned.filter("turn = 1").select(*keys, part, F.row_number().over(
        Window.partitionBy(*keys).orderBy(*names, "seq")).alias("part_no"))
    shared = turned.join(heads, [*keys, part]).drop(*names)
    if limit is None:
        return shared
    slots = Window.partitionBy(*keys).orderBy("turn", "part_no")
    return shared.withColumn("slot", F.row_number().over(slots)).filter(F.col("slot") <= limit)


def review_candidates(photos: DataFrame, min_confidence: int = MIN_REVIEW_CONFIDENCE) -> DataFrame:
    """Photos whose tier a visual verdict can still change, with at least one positive sign of the place."""
    signed = F.exists("evidence", lambda e: e["type"].isin("geo", "category", "text") & (e["weight"] > 0))
    settled = (F.col("vision_label") == "campus_place") & (F.col("tier") == "verified")
    addressed = F.coalesce(F.coalesce(F.nullif("thumb_url", F.lit("")), F.col("full_url")) != "", F.lit(False))
    return photos.filter(
        ~F.col("vision_veto") & addressed & (F.col("confidence") >= min_confidence)
        & ~F.coalesce(settled, F.lit(False)) & signed)


def review_priority(photos: DataFrame, limit: int = REVIEW_LIMIT) -> DataFrame:
    """The first unchecked photos of each profile by trust, confidence and recency."""
    best = Window.partitionBy("profile_id").orderBy(
        F.desc(reliable().cast("int")), F.desc("confidence"), F.desc((F.col("freshness") == "2024_plus").cast("int")), "seq")
    return photos.filter(~F.col("vision_checked")).withColumn("priority", F.row_number().over(best)).filter(
        F.col("priority") <= limit)


def recent_then_backfill(rows: DataFrame, keys: list[str], recent: Column, min_n: int) -> DataFrame:
    """Recent rows; older ones only for keys with fewer than `min_n` recent rows."""
    enough = rows.groupBy(*keys).agg(F.count_if(recent).alias("_recent")).filter(F.col("_recent") >= min_n).select(*keys)
    older = rows.filter(~F.coalesce(recent, F.lit(False))).join(enough, keys, "left_anti")
    return rows.filter(recent).unionByName(older)


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], limit: int, out: str = "position") -> DataFrame:
    """The first `limit` rows per key; Spark cuts each task's rows before the shuffle."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col(out) <= limit)


def sort_by_date(photos: DataFrame) -> DataFrame:
    has_taken = F.coalesce(F.col("date_taken") != "", F.lit(False))
    has_upload = F.coalesce(F.col("date_uploaded") != "", F.lit(False))
    return photos.orderBy(
        F.desc(F.when(has_taken, 2).when(has_upload, 1).otherwise(0)),
        F.desc(F.when(has_taken, F.col("date_taken")).when(has_upload, F.col("date_uploaded")).otherwise("")), "seq")


def sort_by_confidence(photos: DataFrame) -> DataFrame:
    return photos.orderBy(F.desc("confidence"), "seq")


def gallery_filter(
    photos: DataFrame, tab: str = "all", tags: list[str] | None = None, show_unconfirmed: bool = False,
    show_historic: bool = True,
) -> DataFrame:
    kept = photos
    if tab != "all":
        kept = kept.filter(F.col("category") == tab)
    if not show_unconfirmed:
        kept = kept.filter(reliable())
    if not show_historic:
        kept = kept.filter(F.col("freshness") != "historic")
    if tags:
        kept = kept.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return kept


def page(ordered: DataFrame, size: int) -> DataFrame:
    return ordered.limit(size)


def page_with_rest(ordered: DataFrame, size: int) -> DataFrame:
    """The first `size` rows, each with the number of rows after them."""
    total = ordered.agg(F.count("*").alias("n")).scalar()
    return ordered.limit(size).withColumn("remaining", F.greatest(total - size, F.lit(0)).cast("bigint"))
