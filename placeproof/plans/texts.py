"""Registered queries on text and date functions, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeproof.functions import dates, geo, labels, rules, text
from placeproof.plans import views
from placeproof.plans.registry import query
from placeproof.sources.site import extract_campus_links, filter_fetchable_images

DOCS = "documents"
NORMAL = r"trim(regexp_replace(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _docs(spark, sf_dir, *columns):
    return views.table(spark, sf_dir, DOCS).select("doc_id", "text", *columns)


@query("normalize_text", f"SELECT doc_id, md5({NORMAL.format('text')}) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.normalize_text(F.col("text")).cast("binary")).alias("digest"))


@query("normalize_text_exact", f"SELECT doc_id, md5({NORMAL.format('text')}) AS digest FROM documents")
def normalize_text_exact(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.md5(text.normalize_text_exact(F.col("text")).cast("binary")).alias("digest"))


@query("name_tokens", f"""SELECT doc_id, len(list_filter(string_split({NORMAL.format('text')}, ' '), lambda w: w NOT IN ('', 'the', 'of',
    'and', 'at', 'de', 'der', 'für', 'fur'))) AS words FROM documents""")
def name_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(text.tokens(F.col("text"))).cast("bigint").alias("words"))


@query("is_cyrillic", "SELECT doc_id, regexp_matches(text, '[Ѐ-ӿ]') AS cyrillic FROM documents")
def is_cyrillic(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.is_cyrillic(F.col("text")).alias("cyrillic"))


SENTENCES = r"""parts AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)),
    '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(trim(text, chr(32) || chr(9)
    || chr(10) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS n FROM documents),
    ends AS (SELECT *, lower(rtrim(list_last(regexp_split_to_array(part, '\s+')), '.')) AS word FROM parts),
    cuts AS (SELECT *, coalesce(lag(regexp_matches(word, '^\pL$') OR word IN ('им', 'г', 'гг', 'ул', 'пр', 'т', 'е', 'др', 'св', 'st',
    'dr', 'mr', 'mrs', 'prof', 'e.g', 'i.e', 'vs', 'no')) OVER (PARTITION BY doc_id ORDER BY n), false) AS joined FROM ends),
    numbered AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM cuts),
    sentence AS (SELECT doc_id, s, string_agg(part, ' ' ORDER BY n) AS body FROM numbered GROUP BY ALL HAVING body <> '')"""


@query("split_sentences", f"WITH {SENTENCES} SELECT doc_id, count(*) AS sentences, md5(string_agg(body, '|' ORDER BY s)) AS digest "
                          "FROM sentence GROUP BY doc_id")
def split_sentences(spark, sf_dir):
    parts = text.split_sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", parts.alias("parts")).filter(F.size("parts") > 0).select(
        "doc_id", F.size("parts").cast("bigint").alias("sentences"),
        F.md5(F.array_join("parts", "|").cast("binary")).alias("digest"))


@query("first_sentences", f"WITH {SENTENCES}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM sentence) "
                          "SELECT doc_id, string_agg(body, ' ' ORDER BY s) AS opening FROM top WHERE k <= 4 GROUP BY doc_id")
def first_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.first_sentences(F.col("text"), 4).alias("opening")).filter("opening <> ''")


@query("footnotes_valid")
def footnotes_valid(spark, sf_dir):
    cited = F.regexp_replace("text", r"([.!?])(\s|$)", " [1]$1$2")
    return _docs(spark, sf_dir).select("doc_id", text.footnotes_valid(cited, (F.col("doc_id") % 2).cast("int")).alias("valid"))


@query("title_stem", f"WITH {views.with_views('img')} SELECT id, " + NORMAL.format(
    r"regexp_replace(regexp_replace(regexp_replace(title, '^File:', ''), '\.[^.]*$', ''), '\s*\((cropped|2)\)', '')")
    + " AS stem FROM img")
def title_stem(spark, sf_dir):
    return views.images(spark, sf_dir).select("id", text.title_stem(F.col("title")).alias("stem"))


@query("strip_tags", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest "
                     "FROM pages")
def strip_tags(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("page_id", "html")
    return pages.select("page_id", F.md5(text.strip_tags(F.col("html")).cast("binary")).alias("digest"))


@query("clean_html")
def clean_html(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("page_id", "html")
    return pages.select("page_id", F.length(text.clean_html(F.col("html"))).alias("letters"))


@query("content_id", "SELECT page_id, 'site-' || left(sha1(url), 12) AS id FROM pages")
def content_id(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", text.content_id("site-", F.col("url")).alias("id"))


@query("initials", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN left(left(p_brand, 1) || left(p_type, 1), 4) ELSE
    upper(left(p_name, 3)) END AS short FROM part""")
def initials(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_brand", "p_type")).otherwise(F.col("p_name"))
    return views.table(spark, sf_dir, "part").select("p_partkey", text.initials(name).alias("short"))


@query("search_names", """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'University of ' || n_name || '|N' || n_nationkey ELSE
    'N' || n_nationkey || '|Университет' END AS names FROM nation""")
def search_names(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    even = F.array(F.concat(F.lit("University of "), F.col("n_name")), F.lit("Townname"), F.concat(F.lit("N"), key),
                   F.concat(F.lit("N"), key))
    odd = F.array(F.concat(F.lit("N"), key), F.lit("Cambridge"), F.lit("Университет"))
    names = F.when(F.col("n_nationkey") % 2 == 0, even).otherwise(odd)
    return views.table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(text.search_names(names), "|").alias("names"))


@query("name_similarity")
def name_similarity(spark, sf_dir):
    """Supplier names against the customers of their nation that share their number's first digit: a blocked comparison."""
    s = views.table(spark, sf_dir, "supplier").select("s_name", F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("key"))
    c = views.table(spark, sf_dir, "customer").select("c_name", F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("key"))
    return s.join(c, ["k", "key"], "full_outer").select(
        "k", "key", text.name_similarity(F.col("s_name"), F.col("c_name")).alias("likeness"))


def _kind_sql() -> str:
    order = ["dormitory", "library", "laboratory", "stadium", "canteen", "school", "yes"]
    return f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'dorm' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'library' ELSE
        'other' END WHEN 2 THEN 'lab' WHEN 3 THEN 'sport' WHEN 4 THEN 'food' WHEN 5 THEN 'academic' ELSE CASE p_partkey % 3 WHEN 0
        THEN 'dorm' WHEN 1 THEN 'sport' ELSE 'other' END END AS kind FROM part -- {len(order)} kinds of tag"""


@query("building_type", _kind_sql())
def building_type(spark, sf_dir):
    tag = F.expr(views.case("p_partkey % 7", ["dormitory", "library", "laboratory", "stadium", "canteen", "school", "yes"]))
    key = F.when((F.col("p_partkey") % 7 == 1) & (F.col("p_partkey") % 2 == 0), "amenity").otherwise("building")
    name = F.expr(views.case("p_partkey % 3", ["Student Residence Hall", "Old Gym", "Tower"]))
    tags = F.create_map(key, tag, F.lit("name"), F.when(F.col("p_partkey") % 7 == 6, name).otherwise("Block"))
    return views.table(spark, sf_dir, "part").select("p_partkey", rules.building_type(tags).alias("kind"))


# ---- dates ----

RAW = views.case("o_orderkey % 11", views.RAW_DATES)
GOOD = views.case("o_orderkey % 11", ["2024-05-02", "2024-02", "2021", None, "2019-03-04", None, None, None, None, "1999-12-31",
                                      "2018"])


@query("normalize_date", f"SELECT o_orderkey, {GOOD} AS fixed, CASE WHEN o_orderdate <= DATE '1998-01-01' THEN strftime(o_orderdate, "
                         "'%Y-%m-%d') END AS ordered FROM orders")
def normalize_date(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    stamp = F.date_format("o_orderdate", "'+'yyyy-MM-dd'T'HH:mm:ss'Z'")
    return orders.select(
        "o_orderkey", dates.normalize_date(F.expr(RAW), F.lit(views.TODAY).cast("date")).alias("fixed"),
        dates.normalize_date(stamp, F.lit("1998-01-01").cast("date")).alias("ordered"))


@query("unix_date", """SELECT event_id, CAST(DATE '1970-01-01' + CAST(floor((event_id - 500) * 86413 / 86400e0) AS INT) AS VARCHAR) AS day_s,
    CASE WHEN event_id % 2 = 0 THEN CAST(DATE '1970-01-01' + CAST(floor(event_id * 1000003 / 86400000e0) AS INT) AS VARCHAR) END AS day_ms
    FROM events""")
def unix_date(spark, sf_dir):
    today = F.lit("2300-01-01").cast("date")
    millis = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") * 1_000_003).cast("string")).otherwise("soon")
    return views.table(spark, sf_dir, "events").select(
        "event_id", dates.unix_date((F.col("event_id") - 500) * 86_413, today).alias("day_s"),
        dates.unix_date(millis, today, millis=True).alias("day_ms"))


YEAR = "regexp_extract({}, '(?:^|[^0-9])((?:18|19|20)[0-9][0-9])(?:[^0-9]|$)', 1)"


@query("text_year", f"""WITH y AS (SELECT doc_id, {YEAR.format("'hall ' || (1795 + doc_id % 300) || ' view'")} AS a,
    {YEAR.format('text')} AS b FROM documents) SELECT doc_id, CASE WHEN a <> '' AND CAST(a AS INT) <= 2026 THEN CAST(a AS INT)
    WHEN b <> '' AND CAST(b AS INT) <= 2026 THEN CAST(b AS INT) END AS year FROM (SELECT doc_id, a, b FROM y)""")
def text_year(spark, sf_dir):
    title = F.concat(F.lit("hall "), (F.lit(1795) + F.col("doc_id") % 300).cast("string"), F.lit(" view"))
    return _docs(spark, sf_dir).select(
        "doc_id", dates.text_year(F.lit(views.TODAY).cast("date"), title, F.col("text")).alias("year"))


@query("messy_date", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderkey % 3 WHEN 0 THEN
    strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS claim
    FROM orders""")
def messy_date(spark, sf_dir):
    today = F.lit(views.TODAY).cast("date")
    html = F.concat(F.lit("<time>on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at noon</time>"))
    precision = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 10 ELSE 11 END")
    time = F.date_format("o_orderdate", "'+'yyyy-MM-dd'T00:00:00Z'")
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.messy_date(html, today).alias("day"), dates.claim_date(time, precision, today).alias("claim"))


# ---- numbers shown to people ----

@query("distance_labels", """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN CAST(round_even(o_totalprice / 10, 0) * 10 AS BIGINT) ||
    ' m' ELSE printf('%.1f', round_even(o_totalprice / 1000, 1)) || ' km' END AS en FROM orders""")
def distance_labels(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", labels.format_distance(F.col("o_totalprice"), "en").alias("en"))


@query("travel_minutes", """SELECT o_orderkey, greatest(1, CAST(round_even(o_totalprice / 1e4 / 4.8e0 * 60, 0) AS INT)) AS walk,
    greatest(1, CAST(round_even(o_totalprice / 60, 0) AS INT)) AS drive, CASE WHEN o_custkey % 200 < 60 THEN '~' || (o_custkey % 200) ||
    ' min' ELSE '~' || (o_custkey % 200) // 60 || ' h ' || (o_custkey % 200) % 60 || ' min' END AS shown FROM orders""")
def travel_minutes(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", geo.walk_minutes(F.col("o_totalprice") / 1e4).alias("walk"),
        geo.drive_minutes(F.col("o_totalprice")).alias("drive"),
        geo.format_minutes((F.col("o_custkey") % 200).cast("int")).alias("shown"))


@query("display_height", f"WITH {views.with_views('bldg')} " + """SELECT building_id, round(coalesce(height_m, CASE WHEN levels <> 0 THEN
    levels * 3.2e0 END, 12e0), 6) AS meters FROM bldg""")
def display_height(spark, sf_dir):
    return views.buildings(spark, sf_dir).select(
        "building_id", F.round(geo.display_height_m(F.col("height_m"), F.col("levels")), 6).alias("meters"))


# ---- links and headers ----

LINKED = r"""hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\b[^>]*href\s*=\s*["'']([^"''#]+)["'']', 1, 'i')) AS href
    FROM pages), links AS (SELECT DISTINCT page_id, url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN
    starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || replace(href, '&amp;', '&') ELSE '' END AS link FROM hrefs),
    kept AS (SELECT page_id, link FROM links WHERE regexp_replace(regexp_extract(link, '^https?://([^/?#:]+)', 1), '^www\.', '') =
    regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\.', '') AND regexp_matches(regexp_extract(link,
    '^https?://[^/?#]+([^?#]*)', 1), 'the|la|en|de', 'i'))"""


@query("extract_campus_links", f"WITH {LINKED} " + """SELECT page_id, link, position FROM (SELECT *, row_number() OVER (PARTITION BY page_id
    ORDER BY length(link), link) AS position FROM kept) WHERE position <= 8""")
def extract_links(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    return extract_campus_links(pages, path_words=["the", "la", "en", "de"])


HEADERS = {
    "page_id": "page_id", "status": views.case("page_id % 6", [200, 404, 403, 405, 500, None]),
    "content_type": views.case("page_id % 5", ["image/jpeg", "text/html", "image/svg+xml", "", "image/png"]),
    "content_length": views.case("page_id % 4", ["9999", "10000", "many", None]),
}


@query("filter_fetchable_images", f"WITH h AS ({views.select_sql('pages', HEADERS)}) " + """SELECT page_id FROM h WHERE CASE WHEN status >= 400
    THEN status IN (403, 405) ELSE content_type IN ('image/jpeg', '', 'image/png') AND coalesce(content_length, '') <> '9999' END""")
def fetchable(spark, sf_dir):
    return filter_fetchable_images(views.derived(spark, sf_dir, "pages", HEADERS)).select("page_id")
