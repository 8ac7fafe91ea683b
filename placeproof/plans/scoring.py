"""Registered queries on scored photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.functions import dates, labels, rules, text
from placeproof.operators import dedupe, evidence, ranking, reports
from placeproof.plans import views
from placeproof.plans.registry import query
from placeproof.plans.scored_sql import flagged, located, scored
from placeproof.session import cut_lineage

TARGETS = {"campus": 3, "dorms": 2, "libraries": 4}


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.score(
        views.images(spark, sf_dir), views.campus(spark, sf_dir), views.buildings(spark, sf_dir))


_STORED: dict[tuple[str, str], DataFrame] = {}


def stored_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored photos without their long texts, written once to the shared checkpoint folder.

    Reports that read photos more than once start here, so the text rules run once and not once per pass.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = cut_lineage(photos(spark, sf_dir).drop("title"))
    return _STORED[key]


def forget_stored() -> None:
    """Lets the next report write its photos anew, as a run on its own would."""
    _STORED.clear()


def _sorted_tags() -> F.Column:
    order = F.array(*[F.lit(t) for t in ("dorm", "sport", "labs", "student_life")])
    return F.array_join(F.filter(order, lambda t: F.array_contains("tags", t)), ",")


@query("tiers_per_profile", scored("""SELECT profile_id, count(*) AS photos, count_if(tier = 'verified') AS verified,
    count_if(tier = 'likely') AS likely, count_if(tier = 'unconfirmed') AS hidden FROM photo GROUP BY profile_id"""))
def tiers_per_profile(spark, sf_dir):
    return reports.profile_stats(photos(spark, sf_dir).withColumn("copies", F.lit(0))).drop("duplicates")


@query("score_photos", scored("""SELECT id, profile_id, category, tag_set AS tags, CAST(confidence AS BIGINT) AS confidence, tier,
    freshness, shown_source AS date_source, highlight, coalesce(author, 'unknown') AS author, coalesce(license, 'unknown')
    AS license, building_id, CAST(w_geo AS BIGINT) AS w_geo, CAST(w_content AS BIGINT) AS w_content FROM photo"""))
def score_photos(spark, sf_dir):
    def weight(kind: str):
        return F.aggregate(F.filter("evidence", kind), F.lit(0), lambda s, e: s + e["weight"]).cast("bigint")
    return photos(spark, sf_dir).select(
        "id", "profile_id", "category", _sorted_tags().alias("tags"), F.col("confidence").cast("bigint").alias("confidence"),
        "tier", "freshness", "date_source", "highlight", "author", "license", "building_id",
        F.get("evidence", F.lit(0))["weight"].cast("bigint").alias("w_geo"),
        weight(lambda e: e["type"] == "content").alias("w_content"))


@query("build_evidence", scored("""SELECT id, concat_ws(' ', CASE WHEN geo_key = 'no_geo' THEN 'missing:-6' ELSE 'geo:' || w_geo END,
    CASE WHEN w_building <> 0 THEN 'category:6' END, CASE WHEN w_subject <> 0 THEN 'category:6' END,
    CASE WHEN w_category <> 0 THEN 'category:' || w_category END, CASE WHEN w_name <> 0 THEN 'text:14' END,
    CASE WHEN official THEN 'text:30' END,
    CASE WHEN vision_checked AND vision_label IS NOT NULL THEN 'vision:' || vision_weight END,
    CASE WHEN w_content <> 0 THEN 'content:' || w_content END, CASE WHEN w_license <> 0 THEN 'missing:-12' END,
    CASE WHEN date_taken IS NOT NULL OR date_uploaded IS NOT NULL THEN 'date:0' END,
    CASE WHEN NOT vision_checked THEN 'missing:0' END) AS evidence FROM photo"""))
def build_evidence(spark, sf_dir):
    return photos(spark, sf_dir).select("id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(
        ":", e["type"], e["weight"].cast("string"))), " ").alias("evidence"))


@query("finalize_confidence", scored("""SELECT id, CAST(limited AS BIGINT) AS confidence, CASE WHEN limited >= 80 THEN 'verified'
    WHEN limited >= 60 THEN 'likely' ELSE 'unconfirmed' END AS tier FROM photo"""))
def finalize_confidence(spark, sf_dir):
    raw = evidence.confidence_of(F.col("evidence"))
    return photos(spark, sf_dir).select("id", raw.cast("bigint").alias("confidence"), evidence.tier_of(raw).alias("tier"))


@query("drop_not_a_place", flagged("SELECT id FROM kept"))
def drop_not_a_place(spark, sf_dir):
    return evidence.places(views.images(spark, sf_dir)).select("id")


@query("content_flags", flagged("""SELECT id, people, specimen, food, other_inst FROM flags"""))
def content_flags(spark, sf_dir):
    kept = evidence.places(views.images(spark, sf_dir))
    names = views.campus(spark, sf_dir).select("profile_id", "names")
    return kept.join(names, "profile_id").select(
        "id", evidence.people_or_event().alias("people"), evidence.specimen().alias("specimen"),
        evidence.food_closeup().alias("food"), evidence.other_institution(
            F.col("names"), rules.matches("_own", rules.OTHER_INSTITUTION, "_own_signs")).isNotNull().alias("other_inst"))


@query("text_classes", flagged("""SELECT id, CASE WHEN w_library THEN 'libraries' WHEN w_dorm THEN 'dorms' WHEN w_class THEN
    'classrooms' END AS category, concat_ws(',', CASE WHEN w_dorm THEN 'dorm' END, CASE WHEN w_sport THEN 'sport' END,
    CASE WHEN w_lab_title OR (NOT people AND w_lab) THEN 'labs' END, CASE WHEN w_life THEN 'student_life' END) AS tags
    FROM flags"""))
def text_classes(spark, sf_dir):
    kept = evidence.places(views.images(spark, sf_dir))
    return kept.withColumn("people", evidence.people_or_event()).select(
        "id", evidence.text_category().alias("category"), F.array_join(evidence.text_tags(), ",").alias("tags"))


@query("mentioned_name", flagged("""SELECT id, CASE WHEN named THEN 'NATION ' || profile_id WHEN acronym THEN 'N' || profile_id END
    AS mention FROM flags"""))
def mentioned_name(spark, sf_dir):
    kept = evidence.places(views.images(spark, sf_dir))
    names = views.campus(spark, sf_dir).select("profile_id", text.prepare_names(F.col("names")).alias("prepared"))
    return kept.join(names, "profile_id").select(
        "id", text.mentioned_name(evidence.own_text(), F.col("prepared")).alias("mention"))


@query("official_domain", f"WITH {views.with_views('img')} " + r"""SELECT id, regexp_replace(source_domain, '^www\.', '') = 'u' ||
    profile_id || '.example.org' OR is_official_site AS official FROM img""")
def official_domain(spark, sf_dir):
    sites = views.campus(spark, sf_dir).select("profile_id", "official_domains")
    return views.images(spark, sf_dir).join(sites, "profile_id").select(
        "id", evidence.official_domain(F.col("official_domains")).isNotNull().alias("official"))


@query("showcase_highlights", scored("SELECT id, showcase OR vision_highlight AS shown, highlight FROM photo"))
def showcase_highlights(spark, sf_dir):
    shown = F.col("vision_highlight") | rules.matches(F.lower(evidence.own_text()), rules.SHOWCASE)
    flags = views.images(spark, sf_dir).select("id", shown.alias("shown"))
    return photos(spark, sf_dir).select("id", "highlight").join(flags, "id").select("id", "shown", "highlight")


@query("format_distance", located("""SELECT id, geo_key, CASE WHEN geo_meters < 1000 THEN
    CAST(round_even(geo_meters / 10, 0) * 10 AS BIGINT) || ' m' ELSE printf('%.1f', round_even(geo_meters / 1000, 1)) || ' km' END
    AS shown FROM geo JOIN img USING (seq)"""))
def format_distance(spark, sf_dir):
    from placeproof.operators import spatial
    placed = spatial.locate_on_campus(views.images(spark, sf_dir), views.campus(spark, sf_dir))
    return placed.select("id", F.col("geo.key").alias("geo_key"), labels.format_distance(
        F.col("geo.meters"), "en").alias("shown"))


def _label_sql() -> str:
    keys = list(labels.ENGLISH)
    rows = ", ".join("('{}', '{}', '{}')".format(k, labels.ENGLISH[k].replace("'", "''"), labels.RUSSIAN[k]) for k in keys)
    return f"""WITH t(key, en, ru) AS (VALUES {rows}), k AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'ru' WHEN 1
        THEN 'en' ELSE 'kk' END AS lang, {views.case(f'event_id % {len(keys)}', keys)} AS key FROM events)
        SELECT event_id, replace(CASE WHEN lang = 'ru' THEN ru ELSE en END, '{{n}}', 'N' || user_id) AS label FROM k JOIN t
        USING (key)"""


@query("localize_evidence", _label_sql())
def localize_evidence(spark, sf_dir):
    keys = list(labels.ENGLISH)
    rows = views.table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "CASE event_id % 3 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' ELSE 'kk' END AS lang",
        f"{views.case(f'event_id % {len(keys)}', keys)} AS key")
    filled = F.replace(labels.localize(F.col("key"), F.col("lang")), F.lit("{n}"), F.concat(
        F.lit("N"), F.col("user_id").cast("string")))
    return rows.select("event_id", filled.alias("label"))


@query("date_fields", f"WITH {views.with_views('img')} " + """SELECT id,
    CASE WHEN date_taken IS NOT NULL THEN CASE WHEN date_source = 'unknown' THEN 'source_metadata' ELSE date_source END
        WHEN date_uploaded IS NOT NULL THEN 'upload_only' WHEN date_hint_year IS NOT NULL THEN 'text_hint' ELSE 'unknown' END
        AS source,
    CASE WHEN date_taken IS NOT NULL THEN 'Taken ' || date_taken || ' (' || CASE date_source WHEN 'exif' THEN 'EXIF' WHEN
        'structured_data' THEN 'structured data' ELSE 'source metadata' END || ')'
        WHEN date_uploaded IS NOT NULL THEN 'Upload date only: ' || date_uploaded END AS label,
    CASE WHEN date_taken >= '2024' THEN '2024+' WHEN date_taken IS NOT NULL THEN left(date_taken, 4)
        WHEN date_uploaded IS NOT NULL THEN 'uploaded ' || left(date_uploaded, 4) ELSE 'date unknown' END AS badge,
    CASE WHEN date_taken IS NULL THEN CASE WHEN date_hint_year < 1950 THEN 'historic' ELSE 'date_unknown' END
        WHEN date_taken >= '2024' THEN '2024_plus' WHEN date_taken >= '2020' THEN '2020_2023' WHEN date_taken < '1950' THEN
        'historic' ELSE 'older' END AS freshness FROM img""")
def date_fields(spark, sf_dir):
    taken, uploaded, hint = F.col("date_taken"), F.col("date_uploaded"), F.col("date_hint_year")
    fresh = dates.freshness(taken, hint)
    source = dates.date_source(taken, uploaded, F.col("date_source"), hint)
    return views.images(spark, sf_dir).select(
        "id", source.alias("source"), dates.date_label(taken, uploaded, source, F.lit("en")).alias("label"),
        dates.freshness_badge(taken, uploaded, fresh, F.lit("en")).alias("badge"), fresh.alias("freshness"))


# ---- order and selection ----

RANKED = "row_number() OVER (PARTITION BY profile_id ORDER BY reliable DESC, fresh_rank DESC, confidence DESC, seq)"
BY_CATEGORY = RANKED.replace("PARTITION BY profile_id", "PARTITION BY profile_id, category")


@query("rank_photos", scored(f"SELECT id, profile_id, {RANKED} AS position FROM photo"))
def rank_photos(spark, sf_dir):
    return ranking.with_rank(stored_photos(spark, sf_dir), ["profile_id"], "position").select("id", "profile_id", "position")


@query("select_targets", scored(f"""SELECT id, category, tier FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, category,
    reliable ORDER BY fresh_rank DESC, confidence DESC, seq) AS n FROM photo) WHERE NOT reliable OR n <=
    CASE category WHEN 'campus' THEN 3 WHEN 'dorms' THEN 2 WHEN 'libraries' THEN 4 ELSE 1000000000 END"""))
def select_targets(spark, sf_dir):
    return ranking.select_targets(stored_photos(spark, sf_dir), TARGETS).select("id", "category", "tier")


HIGHLIGHTS = """h0 AS (SELECT *, source_domain = 'www.mapillary.com' AS street FROM photo WHERE highlight AND reliable),
    h1 AS (SELECT *, row_number() OVER (PARTITION BY profile_id, source_url ORDER BY street, fresh_rank DESC, confidence DESC, seq)
        AS p FROM h0),
    h2 AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY street, fresh_rank DESC, confidence DESC, seq) AS
        highlight_no FROM h1 WHERE p = 1),
    high AS (SELECT * FROM h2 WHERE highlight_no <= 4)"""


@query("pick_highlights", scored(f", {HIGHLIGHTS} SELECT id, profile_id, highlight_no FROM high"))
def pick_highlights(spark, sf_dir):
    return ranking.pick_highlights(stored_photos(spark, sf_dir)).select("id", "profile_id", "highlight_no")


@query("showcase_rotation", scored(f""", {HIGHLIGHTS}, parts AS (SELECT p.*, h.highlight_no, CASE WHEN h.seq IS NOT NULL THEN 0
    WHEN p.reliable THEN 1 ELSE 2 END AS part FROM photo p LEFT JOIN high h ON h.seq = p.seq),
    turns AS (SELECT *, row_number() OVER (PARTITION BY profile_id, part, CASE WHEN part = 1 THEN category ELSE '' END
    ORDER BY CASE WHEN part = 0 THEN highlight_no END, fresh_rank DESC, confidence DESC, seq) AS turn FROM parts)
    SELECT id, part, turn AS line FROM turns"""))
def showcase_rotation(spark, sf_dir):
    return ranking.showcase_base(stored_photos(spark, sf_dir)).select("id", "part", F.col("line").cast("bigint").alias("line"))


@query("showcase_order")
def showcase_order(spark, sf_dir):
    return ranking.showcase_order(stored_photos(spark, sf_dir)).select("id", "profile_id", "place")


@query("gallery_filter", scored("""SELECT id FROM photo WHERE reliable AND freshness <> 'historic' AND
    (contains(tag_set, 'labs') OR contains(tag_set, 'sport'))"""))
def gallery_filter(spark, sf_dir):
    return ranking.gallery_filter(stored_photos(spark, sf_dir), tags=["labs", "sport"], show_historic=False).select("id")


@query("review_candidates", scored("""SELECT id FROM photo WHERE NOT vision_veto AND confidence >= 44 AND placed
    AND NOT coalesce(vision_label = 'campus_place' AND tier = 'verified', false)"""))
def review_candidates(spark, sf_dir):
    return ranking.review_candidates(stored_photos(spark, sf_dir)).select("id")


@query("review_round_robin", scored("""SELECT id, slot FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY turn,
    first_n) AS slot FROM (SELECT *, min(n) OVER (PARTITION BY profile_id, source) AS first_n FROM (SELECT *,
    row_number() OVER (PARTITION BY profile_id, source ORDER BY (freshness = '2024_plus') DESC, confidence DESC, seq) AS turn,
    row_number() OVER (PARTITION BY profile_id ORDER BY (freshness = '2024_plus') DESC, confidence DESC, seq) AS n FROM photo
    WHERE NOT vision_veto AND confidence >= 44 AND placed
    AND NOT coalesce(vision_label = 'campus_place' AND tier = 'verified', false)))) WHERE slot <= 6"""))
def review_round_robin(spark, sf_dir):
    order = [-(F.col("freshness") == "2024_plus").cast("int"), -F.col("confidence")]
    return ranking.round_robin(ranking.review_candidates(stored_photos(spark, sf_dir)), "source", order, 6).select("id", "slot")


@query("fair_turns", scored("""SELECT id, row_number() OVER (PARTITION BY profile_id, source ORDER BY (freshness = '2024_plus') DESC,
    confidence DESC, seq) AS turn FROM photo"""))
def fair_turns(spark, sf_dir):
    order = [-(F.col("freshness") == "2024_plus").cast("int"), -F.col("confidence")]
    return ranking.round_robin(stored_photos(spark, sf_dir), "source", order).select("id", "turn")


@query("review_priority", scored("""SELECT id, priority FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY reliable
    DESC, confidence DESC, (freshness = '2024_plus') DESC, seq) AS priority FROM photo WHERE NOT vision_checked)
    WHERE priority <= 140"""))
def review_priority(spark, sf_dir):
    return ranking.review_priority(stored_photos(spark, sf_dir)).select("id", "priority")


@query("sort_by_date", f"WITH {views.with_views('img')} " + """SELECT id, CASE WHEN date_taken IS NOT NULL THEN 2 WHEN date_uploaded IS
    NOT NULL THEN 1 ELSE 0 END AS rank, coalesce(date_taken, date_uploaded, '') AS shown FROM img ORDER BY rank DESC, shown DESC, seq""")
def sort_by_date(spark, sf_dir):
    rank = F.when(F.col("date_taken").isNotNull(), 2).when(F.col("date_uploaded").isNotNull(), 1).otherwise(0)
    return ranking.sort_by_date(views.images(spark, sf_dir)).select(
        "id", rank.alias("rank"), F.coalesce("date_taken", "date_uploaded", F.lit("")).alias("shown"))


@query("sort_by_confidence", scored("SELECT id, CAST(confidence AS BIGINT) AS confidence FROM photo ORDER BY confidence DESC, seq"))
def sort_by_confidence(spark, sf_dir):
    return ranking.sort_by_confidence(stored_photos(spark, sf_dir)).select("id", F.col("confidence").cast("bigint").alias("confidence"))


@query("gallery_page", scored("SELECT id FROM photo WHERE reliable ORDER BY confidence DESC, seq LIMIT 24"))
def gallery_page(spark, sf_dir):
    shown = ranking.gallery_filter(stored_photos(spark, sf_dir))
    return ranking.page(ranking.sort_by_confidence(shown), 24).select("id")


@query("gallery_page_rest", scored("""SELECT id, greatest((SELECT count(*) FROM photo WHERE reliable) - 24, 0) AS remaining FROM photo WHERE reliable
    ORDER BY confidence DESC, seq LIMIT 24"""))
def gallery_page_rest(spark, sf_dir):
    shown = ranking.gallery_filter(stored_photos(spark, sf_dir))
    return ranking.page_with_rest(ranking.sort_by_confidence(shown), 24).select("id", "remaining")


# ---- reports ----

GROUPS_SQL = """keys AS (SELECT profile_id, seq, 'sha1:' || sha1 AS class FROM img WHERE sha1 IS NOT NULL UNION ALL
    SELECT profile_id, seq, 'stem:' || source || ':' || trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(
    regexp_replace(title, '^File:', ''), '\\.[^.]*$', ''), '\\s*\\((cropped|2)\\)', '')), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))
    FROM img),
    link AS (SELECT DISTINCT b.profile_id, b.seq AS x, a.seq AS y FROM keys a JOIN keys b ON a.profile_id = b.profile_id AND
    a.class = b.class AND a.seq < b.seq)"""


@query("group_duplicates", f"WITH RECURSIVE {views.with_views('img')}, {GROUPS_SQL}, " + """reach(seq, y) AS (SELECT seq, seq FROM img
    UNION SELECT r.seq, l.y FROM reach r JOIN link l ON l.x = r.y) SELECT i.id, g.y AS group_seq FROM img i JOIN
    (SELECT seq, min(y) AS y FROM reach GROUP BY seq) g ON g.seq = i.seq""")
def group_duplicates(spark, sf_dir):
    rows = views.images(spark, sf_dir).withColumn("sig", F.lit(None).cast("bigint"))
    return dedupe.group_duplicates(rows).select(F.concat(F.lit("img-"), F.col("seq").cast("string")).alias("id"), "group_seq")


@query("exact_links", f"WITH {views.with_views('img')}, {GROUPS_SQL} " + """SELECT profile_id, class, seq, previous FROM (SELECT *,
    lag(seq) OVER (PARTITION BY profile_id, class ORDER BY seq) AS previous FROM keys) WHERE previous IS NOT NULL""")
def exact_links(spark, sf_dir):
    rows = views.images(spark, sf_dir).withColumn("sig", F.lit(None).cast("bigint"))
    return dedupe.exact_links(rows).select("profile_id", "class", "seq", "previous")


HEADS = """grp AS (SELECT *, row_number() OVER (PARTITION BY profile_id, source_url ORDER BY confidence DESC, seq) AS n,
    count(*) OVER (PARTITION BY profile_id, source_url) - 1 AS copies FROM photo)"""


@query("group_result", scored(f", {HEADS} SELECT id, n = 1 AS is_head, copies FROM grp"))
def group_result(spark, sf_dir):
    grouped = stored_photos(spark, sf_dir).withColumn("group_seq", F.regexp_extract("source_url", r"(\d+)$", 1).cast("bigint"))
    return dedupe.group_result(grouped).select("id", "is_head", "copies")


@query("profile_stats", scored(f""", {HEADS} SELECT profile_id, count(*) AS photos, count_if(tier = 'verified') AS verified,
    count_if(tier = 'likely') AS likely, count_if(tier = 'unconfirmed') AS hidden, CAST(sum(copies) AS BIGINT) AS duplicates FROM grp
    WHERE n = 1 GROUP BY profile_id"""))
def profile_stats(spark, sf_dir):
    grouped = stored_photos(spark, sf_dir).withColumn("group_seq", F.regexp_extract("source_url", r"(\d+)$", 1).cast("bigint"))
    return reports.profile_stats(dedupe.keep_heads(grouped))


@query("tab_counts", scored("""SELECT profile_id, tab, count(*) AS every, count_if(reliable) AS reliable FROM (SELECT profile_id, 'all'
    AS tab, reliable FROM photo UNION ALL SELECT profile_id, category, reliable FROM photo) GROUP BY ALL"""))
def tab_counts(spark, sf_dir):
    return reports.tab_counts(stored_photos(spark, sf_dir))


@query("category_gaps", scored("""SELECT n.profile_id, c.category, count(p.seq) AS reliable FROM campus n CROSS JOIN (VALUES ('dorms'),
    ('libraries'), ('classrooms')) c(category) LEFT JOIN photo p ON p.profile_id = n.profile_id AND p.category = c.category AND
    p.reliable GROUP BY ALL HAVING count(p.seq) < 3"""))
def category_gaps(spark, sf_dir):
    return reports.category_gaps(views.campus(spark, sf_dir), stored_photos(spark, sf_dir))


@query("compare_profiles", scored("SELECT profile_id, " + ", ".join(
    f"count_if(category = '{c}' AND tier = 'verified') AS verified_{c}, count_if(category = '{c}' AND reliable) AS reliable_{c}"
    for c in ("campus", "dorms", "classrooms", "libraries", "city")) +
    ", count_if(reliable AND freshness = '2024_plus') AS recent FROM photo GROUP BY profile_id"))
def compare_profiles(spark, sf_dir):
    return reports.compare_profiles(stored_photos(spark, sf_dir))


@query("quality_report", scored("""SELECT profile_id, count(*) AS photos, count_if(tier = 'verified') AS verified,
    count_if(reliable AND category = 'campus') AS reliable_campus, round(count_if(date_taken IS NOT NULL) / count(*), 6) AS dated_share,
    count_if(reliable AND freshness = '2024_plus') AS recent, median(CASE WHEN reliable THEN date_diff('day', CAST(date_taken ||
    CASE length(date_taken) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS DATE), DATE '2026-09-17') END) AS
    median_age_days FROM photo GROUP BY profile_id"""))
def quality_report(spark, sf_dir):
    report = reports.quality_report(stored_photos(spark, sf_dir), F.lit(views.TODAY).cast("date"))
    return report.select("profile_id", "photos", "verified", "reliable_campus", F.round("dated_share", 6).alias("dated_share"),
                         "recent", "median_age_days")


@query("tab_notices", scored("""SELECT profile_id, tab, count_if(tagged AND NOT reliable) AS hidden_unconfirmed, count_if(reliable AND NOT
    tagged) AS filtered_out, tab <> 'all' AND count_if(reliable AND freshness = '2024_plus') = 0 AS no_recent FROM (SELECT *, 'all' AS
    tab, contains(tag_set, 'labs') AS tagged FROM photo UNION ALL SELECT *, category, contains(tag_set, 'labs') FROM photo)
    GROUP BY profile_id, tab"""))
def tab_notices(spark, sf_dir):
    return reports.tab_notices(stored_photos(spark, sf_dir), ["labs"])


@query("source_metrics", scored(""", s AS (SELECT profile_id, source, count(*) AS candidates, count_if(vision_veto) AS vetoed FROM img
    GROUP BY ALL), k AS (SELECT profile_id, source, count(*) AS shown FROM photo WHERE reliable GROUP BY ALL)
    SELECT s.profile_id, s.source, candidates, vetoed, coalesce(shown, 0) AS shown, greatest(0, candidates - coalesce(shown, 0) -
    vetoed) AS hidden, CASE WHEN candidates % 2 = 0 THEN 'ok' ELSE 'timeout' END AS status FROM s LEFT JOIN k USING (profile_id, source)"""))
def source_metrics(spark, sf_dir):
    rows = views.images(spark, sf_dir)
    status = rows.groupBy("profile_id", "source").agg(F.when(F.count("*") % 2 == 0, "ok").otherwise("timeout").alias("status"))
    shown = stored_photos(spark, sf_dir).filter(ranking.reliable())
    return reports.source_metrics(rows, shown, status).select(
        "profile_id", "source", "candidates", "vetoed", "shown", "hidden", "status")


@query("gap_queries", scored(""", gap AS (SELECT n.profile_id, n.name, c.category FROM campus n CROSS JOIN (VALUES ('dorms'),
    ('libraries'), ('classrooms')) c(category) LEFT JOIN photo p ON p.profile_id = n.profile_id AND p.category = c.category AND
    p.reliable GROUP BY ALL HAVING count(p.seq) < 3), topic(category, topic) AS (VALUES ('libraries', 'library'), ('libraries',
    'library reading room'), ('dorms', 'dormitory'), ('dorms', 'student housing residence hall'), ('classrooms',
    'lecture hall classroom'), ('classrooms', 'laboratory building')) SELECT profile_id, category, left('"' || name || '" ' || topic ||
    ' site:u' || profile_id || '.example.org', 400) AS query FROM gap JOIN topic USING (category)"""))
def gap_queries(spark, sf_dir):
    profiles = views.campus(spark, sf_dir).select(
        "profile_id", F.get("names", F.lit(0)).alias("name"),
        F.concat(F.lit("https://www."), F.get("official_domains", F.lit(0)), F.lit("/en")).alias("website"))
    gaps = reports.category_gaps(profiles, stored_photos(spark, sf_dir))
    return reports.gap_queries(gaps, profiles)


@query("withdrawn_photos", scored("SELECT i.id FROM img i WHERE i.seq NOT IN (SELECT seq FROM photo WHERE reliable)"))
def withdrawn_photos(spark, sf_dir):
    from placeproof.operators import events
    final = stored_photos(spark, sf_dir).filter(ranking.reliable())
    return events.withdrawn(views.images(spark, sf_dir).select("profile_id", "id"), final, ["profile_id", "id"]).select("id")
