"""The scoring pipeline said once more in plain SQL, as the independent check of `score` and everything built on it.

Rule words come from the shared vocabulary; the checking engine has no look-ahead, so place phrases are blanked first and
the bare word is searched afterwards.
"""

from __future__ import annotations

import re

from placeproof.functions import rules
from placeproof.plans.views import with_views

LETTER = r"[\pL\pN_]"
BEFORE, AFTER = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
WITH_ASCII = ["own", "every", "about"]


def _plain(word: str) -> str:
    out = re.sub(r"^\\b", lambda _: BEFORE, word)
    return out.replace(r"\b", AFTER)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def match(text: str, words: list[str]) -> str:
    """Boolean SQL: lower-cased `text` matches any word.

    ASCII words run on `<text>_a`, where other letters read x and other signs read blank, so the engine's ASCII word
    boundary is right; the few words with other letters run on the text itself.
    """
    ascii_text = f"{text}_a" if text in WITH_ASCII else text
    tests = []
    for column, chosen in ((ascii_text, [w for w in words if w.isascii()]), (text, [w for w in words if not w.isascii()])):
        spelled = (lambda w: w) if column == ascii_text else _plain
        simple = [spelled(w) for w in chosen if "(?!" not in w]
        if simple:
            tests.append(f"regexp_matches({column}, {quoted('|'.join(f'(?:{w})' for w in simple))})")
        for word in chosen:
            if "(?!" in word:
                head, tail = word.split("(?!", 1)
                phrase = head.removesuffix(r"\b")
                blank = f"regexp_replace({column}, {quoted(spelled(phrase) + '(?:' + tail[:-1] + ')')}, ' ', 'g')"
                tests.append(f"regexp_matches({blank}, {quoted(spelled(head))})")
    return "(" + " OR ".join(tests) + ")"


def any_match(columns: list[str], words: list[str]) -> str:
    return "(" + " OR ".join(match(f"lower({c})", words) for c in columns) + ")"


CATEGORIES = ["category_a", "category_b"]


def ascii_only(text: str) -> str:
    letters = "[ªµºÀ-ÖØ-öø-˿Ͱ-\u1fff\u3040-\uffdc]"
    return f"regexp_replace(regexp_replace({text}, '{letters}', 'x', 'g'), '[^\\x00-\\x7F]', ' ', 'g')"


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (f"2 * 6371000e0 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)))")


GEO_CTES = f"""
ring AS (SELECT c.profile_id, c.lng + e.ax / 1e3 AS x1, c.lat + e.ay / 1e3 AS y1, c.lng + e.zx / 1e3 AS x2,
    c.lat + e.zy / 1e3 AS y2 FROM campus c, edges e WHERE c.outlined),
spot AS (SELECT i.seq, i.lat, i.lng, r.*, greatest(0e0, least(1e0, ((i.lng - x1) * (x2 - x1) + (i.lat - y1) * (y2 - y1))
    / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t
    FROM img i JOIN ring r ON r.profile_id = i.profile_id WHERE i.lat IS NOT NULL),
near AS (SELECT *, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM spot),
folded AS (SELECT seq, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1
    ELSE 0 END) % 2 = 1 AS inside, arg_min(px, pow(lng - px, 2) + pow(lat - py, 2)) AS px,
    arg_min(py, pow(lng - px, 2) + pow(lat - py, 2)) AS py FROM near GROUP BY seq),
geo_raw AS (SELECT i.seq, c.outlined, i.lat IS NULL AS nowhere, f.inside,
    {haversine('c.lat', 'c.lng', 'i.lat', 'i.lng')} AS from_center, {haversine('i.lat', 'i.lng', 'f.py', 'f.px')} AS away
    FROM img i JOIN campus c ON c.profile_id = i.profile_id LEFT JOIN folded f ON f.seq = i.seq),
geo AS (SELECT seq,
    CASE WHEN nowhere THEN 'no_geo' WHEN outlined THEN CASE WHEN inside THEN 'geo_inside' WHEN away <= 250 THEN 'geo_edge'
        WHEN away <= 1000 THEN 'geo_just_outside' ELSE 'geo_away' END
        ELSE CASE WHEN from_center <= 500 THEN 'geo_near_point' WHEN from_center <= 3000 THEN 'geo_point' ELSE 'geo_away' END
        END AS geo_key,
    CASE WHEN nowhere THEN NULL WHEN outlined AND NOT inside THEN away ELSE from_center END AS geo_meters,
    CASE WHEN nowhere THEN -6 WHEN outlined THEN CASE WHEN inside THEN 28 WHEN away <= 250 THEN 12 WHEN away <= 1000 THEN 4
        WHEN away <= 3000 THEN -10 ELSE -30 END
        ELSE CASE WHEN from_center <= 500 THEN 20 WHEN from_center <= 1500 THEN 6 WHEN from_center <= 3000 THEN 0
        WHEN from_center <= 10000 THEN -10 ELSE -30 END END AS geo_weight,
    CASE WHEN nowhere THEN NULL WHEN outlined THEN inside WHEN from_center <= 500 THEN true WHEN from_center <= 3000 THEN NULL
        ELSE false END AS on_campus FROM geo_raw)"""
HIT_CTE = """
hit AS (SELECT i.seq, min(b.ord) AS ord FROM img i JOIN bldg b ON b.profile_id = i.profile_id
    AND i.lng > b.cx - b.hw AND i.lng < b.cx + b.hw AND i.lat > b.cy - b.hh AND i.lat < b.cy + b.hh GROUP BY i.seq)"""

NOT_A_PHOTO_CATEGORY = [rf"^(?:{w})\b" for w in rules.NOT_A_PHOTO_CATEGORY_START] + [r"\bmicrographs\b"]
PERSON_WORDS = [*rules.GROUP_OF_PEOPLE, *rules.PERSON_CATEGORY, *rules.EVENT_CATEGORY]
NORMALIZED = r"' ' || regexp_replace(replace(own, 'ß', 'ss'), '[^\pL\pN_]+', ' ', 'g') || ' '"
OTHER = rules.OTHER_INSTITUTION

TEXT_CTES = f"""
low AS (SELECT *, lower(title || ' ' || description) AS own, lower(description) AS about,
    lower(title || ' ' || description || ' ' || category_a || ' ' || category_b) AS every FROM img),
txt AS MATERIALIZED (SELECT *, {ascii_only('own')} AS own_a, {ascii_only('every')} AS every_a, {ascii_only('about')} AS about_a
    FROM low),
kept AS (SELECT * FROM txt WHERE NOT {match('own', rules.NOT_A_PHOTO)} AND NOT {any_match(CATEGORIES, NOT_A_PHOTO_CATEGORY)}),
flags AS MATERIALIZED (SELECT *,
    {match('every', rules.PEOPLE_OR_EVENT)} OR {match('lower(title)', rules.GROUP_OF_PEOPLE)}
        OR {any_match(CATEGORIES, PERSON_WORDS)} AS people,
    {match('every', rules.SPECIMEN)} OR {any_match(CATEGORIES, rules.SPECIMEN_CATEGORY)} AS specimen,
    {match('every', rules.FOOD_CLOSEUP)} AS food,
    {match('own', OTHER)} OR {match("lower(coalesce(matched_category, ''))", OTHER)} AND NOT
        contains(lower(coalesce(matched_category, '')), 'nation ' || profile_id) OR {match('lower(category_a)', OTHER)}
        OR {match('lower(category_b)', OTHER)} AND NOT contains(lower(category_b), 'nation ' || profile_id) AS other_inst,
    contains({NORMALIZED}, ' nation ' || profile_id || ' ') AS named,
    contains(' ' || regexp_replace(title || ' ' || description, '[^A-Za-z0-9]', ' ', 'g') || ' ', ' N' || profile_id || ' ')
        AS acronym,
    regexp_replace(source_domain, '^www\\.', '') = 'u' || profile_id || '.example.org' OR is_official_site AS official,
    {match('every', rules.LIBRARY)} AS w_library, {match('every', rules.DORM)} AS w_dorm,
    {match('every', rules.CLASSROOM)} AS w_class, {match('every', rules.SPORT)} AS w_sport,
    {match('every', rules.STUDENT_LIFE)} AS w_life, {match('lower(title)', rules.LAB)} AS w_lab_title,
    {match('about', rules.LAB)} OR {any_match(CATEGORIES, rules.LAB)} AS w_lab,
    {match("lower(coalesce(matched_category, ''))", rules.LIBRARY)} AS sub_library,
    {match("lower(coalesce(matched_category, ''))", rules.DORM)} AS sub_dorm,
    {match('own', rules.SHOWCASE)} AS showcase FROM kept)""".replace("\\\\.", "\\.")

SCORED_CTES = f"""
joined AS (SELECT f.*, g.geo_key, g.geo_meters, g.geo_weight, g.on_campus, b.ord AS b_ord, b.building_id,
    b.type AS b_type, coalesce(b.inside_campus, false) AS b_inside,
    f.matched_category IS NOT NULL OR f.named OR f.acronym OR f.official AS linked
    FROM flags f JOIN geo g ON g.seq = f.seq LEFT JOIN hit h ON h.seq = f.seq LEFT JOIN bldg b ON b.ord = h.ord),
weighed AS (SELECT *,
    coalesce(NOT on_campus, lat IS NOT NULL AND NOT linked) AS off_campus,
    geo_weight AS w_geo,
    CASE WHEN b_inside THEN 6 ELSE 0 END AS w_building,
    CASE WHEN subject_kind = 'building' THEN 6 ELSE 0 END AS w_subject,
    CASE WHEN matched_category IS NULL THEN 0 WHEN matched_subcategory THEN 16 ELSE 22 END AS w_category,
    CASE WHEN named OR acronym THEN 14 ELSE 0 END AS w_name, CASE WHEN official THEN 30 ELSE 0 END AS w_official,
    CASE WHEN vision_checked AND vision_label IS NOT NULL THEN vision_weight ELSE 0 END AS w_vision,
    CASE WHEN other_inst THEN -20 WHEN people OR specimen OR food THEN -15 ELSE 0 END AS w_content,
    CASE WHEN license IS NULL AND NOT official THEN -12 ELSE 0 END AS w_license FROM joined),
summed AS (SELECT *, greatest(0, least(100, 40 + w_geo + w_building + w_subject + w_category + w_name + w_official + w_vision
    + w_content + w_license)) AS total,
    (geo_key <> 'no_geo' AND w_geo > 0) OR w_building + w_subject + w_category + w_name + w_official > 0 AS placed FROM weighed),
capped AS (SELECT *, CASE WHEN placed AND w_content = 0 THEN total ELSE least(total, 59) END AS limited FROM summed),
final AS (SELECT *, CASE WHEN vision_veto THEN least(limited, 59) WHEN NOT vision_checked AND limited >= 80 THEN 79
    ELSE limited END AS confidence FROM capped),
tiered AS (SELECT *, CASE WHEN confidence >= 80 THEN 'verified' WHEN confidence >= 60 THEN 'likely' ELSE 'unconfirmed' END AS tier,
    CASE WHEN NOT off_campus AND subject_building_type = 'dorm' THEN 'dorms'
        WHEN NOT off_campus AND vision_category IS NOT NULL THEN vision_category
        WHEN matched_subcategory AND sub_library THEN 'libraries' WHEN matched_subcategory AND sub_dorm THEN 'dorms'
        WHEN b_type = 'library' THEN 'libraries' WHEN b_type = 'dorm' THEN 'dorms'
        WHEN w_library THEN 'libraries' WHEN w_dorm THEN 'dorms' WHEN w_class THEN 'classrooms'
        WHEN off_campus AND NOT linked THEN 'city' ELSE 'campus' END AS category,
    CASE WHEN date_taken IS NULL THEN CASE WHEN date_hint_year < 1950 THEN 'historic' ELSE 'date_unknown' END
        WHEN CAST(left(date_taken, 4) AS INT) >= 2024 THEN '2024_plus' WHEN CAST(left(date_taken, 4) AS INT) >= 2020 THEN
        '2020_2023' WHEN CAST(left(date_taken, 4) AS INT) < 1950 THEN 'historic' ELSE 'older' END AS freshness,
    CASE WHEN date_taken IS NOT NULL THEN CASE WHEN date_source = 'unknown' THEN 'source_metadata' ELSE date_source END
        WHEN date_uploaded IS NOT NULL THEN 'upload_only' WHEN date_hint_year IS NOT NULL THEN 'text_hint' ELSE 'unknown' END
        AS shown_source,
    concat_ws(',', CASE WHEN w_dorm OR b_type = 'dorm' THEN 'dorm' END, CASE WHEN w_sport OR b_type = 'sport' THEN 'sport' END,
        CASE WHEN w_lab_title OR (NOT people AND w_lab) OR b_type = 'lab' THEN 'labs' END,
        CASE WHEN w_life THEN 'student_life' END) AS tag_set FROM final),
photo AS MATERIALIZED (SELECT *, category = 'campus' AND tier <> 'unconfirmed' AND (vision_highlight OR showcase) AS highlight,
    tier <> 'unconfirmed' AS reliable,
    confidence + CASE freshness WHEN '2024_plus' THEN 20 WHEN '2020_2023' THEN 10 WHEN 'historic' THEN -10 ELSE -5 END AS fresh_rank
    FROM tiered)"""


def scored(rest: str) -> str:
    """A check over scored photos: the table `photo` has one row per photo that is kept."""
    views = with_views("img", "campus", "bldg", "edges")
    return f"WITH {views}, {GEO_CTES}, {HIT_CTE}, {TEXT_CTES}, {SCORED_CTES} {rest}"


def located(rest: str) -> str:
    return f"WITH {with_views('img', 'campus', 'bldg', 'edges')}, {GEO_CTES}, {HIT_CTE} {rest}"


def flagged(rest: str) -> str:
    return f"WITH {with_views('img')}, {TEXT_CTES} {rest}"
