"""Registered queries on source payloads: JSON and XML texts are written from the given tables, then normalised."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeproof.functions import geo
from placeproof.plans import views
from placeproof.plans.registry import query
from placeproof.sources import images, maps, site


def _today():
    return F.lit(views.TODAY).cast("date")


def _docs(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def _payload(rows, struct: str):
    return rows.selectExpr("doc_id % 25 AS profile_id", "doc_id AS seq", f"to_json({struct}) AS payload")


META = """map('Artist', named_struct('value', CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<b>A&amp;B</b> ' || lang END), 'LicenseShortName',
    named_struct('value', 'CC0'), 'DateTimeOriginal', named_struct('value', 'about <i>2019-05-06</i>'), 'ImageDescription', named_struct('value',
    text), 'Categories', named_struct('value', 'One|Two||' || lang))"""
COMMONS = f"""named_struct('pageid', doc_id, 'title', 'File:' || (1900 + doc_id % 150) || '.jpg', 'structured_date', CASE WHEN doc_id % 4 = 0 THEN
    '2022-02' END, 'coordinates', array(named_struct('lat', doc_id * 1e-3, 'lon', 5e-1)), 'imageinfo', array(named_struct('url', 'https://f/' ||
    doc_id, 'mime', CASE doc_id % 5 WHEN 4 THEN 'image/svg+xml' ELSE 'image/jpeg' END, 'sha1', 's' || doc_id, 'timestamp',
    '2023-01-02T03:04:05Z', 'width', 150 + doc_id % 100, 'height', 900, 'metadata', array(named_struct('name', 'DateTimeOriginal', 'value', CASE
    WHEN doc_id % 6 = 0 THEN '2020-07-08 09:10' END)), 'extmetadata', {META})))"""
CLEAN = r"trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("normalize_commons", f"""SELECT 'commons-' || doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN '2020-07-08' WHEN doc_id % 4 = 0 THEN '2022-02' ELSE
    '2019-05-06' END AS date_taken, CASE WHEN doc_id % 6 = 0 THEN 'exif' WHEN doc_id % 4 = 0 THEN 'structured_data' ELSE 'source_metadata' END AS
    date_source, '2023-01-02' AS date_uploaded, CASE WHEN doc_id % 3 <> 0 THEN 'A&B ' || lang END AS author, 'One|Two|' || lang AS categories,
    CASE WHEN 1900 + doc_id % 150 <= 2026 THEN 1900 + doc_id % 150 END AS hint, round(doc_id * 1e-3, 6) AS lat FROM documents WHERE doc_id % 5 <>
    4 AND 150 + doc_id % 100 >= 200""")
def normalize_commons(spark, sf_dir):
    rows = images.normalize_commons(_payload(_docs(spark, sf_dir), COMMONS), _today())
    hint = F.when(F.regexp_extract("title", r"(\d+)", 1).cast("int") <= 2026, F.col("date_hint_year"))
    return rows.select("id", "date_taken", "date_source", "date_uploaded", "author", F.array_join("source_categories", "|").alias("categories"),
                       hint.alias("hint"), F.round("lat", 6).alias("lat"))


FLICKR = """named_struct('id', doc_id, 'owner', 'o' || doc_id % 9, 'title', lang, 'license', CAST(doc_id % 18 AS STRING), 'description', CASE WHEN
    doc_id % 2 = 0 THEN named_struct('_content', '<p>' || lang || '</p> x') END, 'dateupload', CAST(1699920000 + doc_id % 600 * 86400 AS
    STRING), 'datetaken', CASE doc_id % 3 WHEN 0 THEN CAST(date_add(DATE '2023-11-14', CAST(doc_id % 600 AS INT)) AS STRING)
    || ' 10:00:00' WHEN 1 THEN '2016-01-01 00:00:00' ELSE '2015-05-05 00:00:00' END, 'datetakenunknown', CASE WHEN doc_id % 3 = 2 THEN '1' ELSE
    '0' END, 'ownername', 'n', 'latitude', CASE WHEN doc_id % 4 = 0 THEN '0' ELSE CAST(doc_id % 90 AS STRING) END, 'longitude', CASE WHEN doc_id %
    4 = 0 THEN '0' ELSE '12.5' END, 'tags', 'a  b ' || lang, 'media', CASE WHEN doc_id % 7 = 6 THEN 'video' ELSE 'photo' END, 'url_l', CASE WHEN
    doc_id % 5 = 0 THEN 'https://l/' || doc_id END, 'width_l', '800', 'height_l', CASE WHEN doc_id % 11 = 0 THEN '100' ELSE '600' END, 'url_z',
    'https://z/' || doc_id, 'width_z', '640', 'height_z', '480')"""


@query("normalize_flickr", """SELECT 'flickr-' || doc_id AS id, license, CASE WHEN doc_id % 5 = 0 THEN 'https://l/' ELSE 'https://z/' END || doc_id
    AS full_url, CASE WHEN doc_id % 3 = 1 THEN '2016-01-01' END AS date_taken, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 90 AS DOUBLE) END AS
    lat, CASE WHEN doc_id % 2 = 0 THEN lang || ' x' ELSE '' END AS description, 'a|b|' || lang AS tags FROM documents JOIN (VALUES
    (1, 'CC BY-NC-SA 2.0'), (2, 'CC BY-NC 2.0'), (3, 'CC BY-NC-ND 2.0'), (4, 'CC BY 2.0'), (5, 'CC BY-SA 2.0'), (6, 'CC BY-ND 2.0'), (9,
    'CC0 1.0'), (10, 'Public Domain Mark 1.0'), (11, 'CC BY 4.0'), (12, 'CC BY-SA 4.0'), (13, 'CC BY-ND 4.0'), (14, 'CC BY-NC 4.0'), (15,
    'CC BY-NC-SA 4.0'), (16, 'CC BY-NC-ND 4.0')) l(code, license) ON code = doc_id % 18 WHERE doc_id % 7 <> 6 AND NOT (doc_id % 5 = 0 AND doc_id
    % 11 = 0)""")
def normalize_flickr(spark, sf_dir):
    rows = images.normalize_flickr(_payload(_docs(spark, sf_dir), FLICKR), _today())
    return rows.select("id", "license", "full_url", "date_taken", "lat", "description", F.array_join("source_categories", "|").alias("tags"))


@query("license_lookup", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'CC BY 2.0' ELSE 'CC BY-ND 4.0' END AS license FROM documents WHERE doc_id
    % 3 <> 2""")
def license_lookup(spark, sf_dir):
    coded = views.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE doc_id % 3 WHEN 0 THEN '4' WHEN 1 THEN '13' ELSE '0' END AS license")
    return images.with_license(coded).select("doc_id", "license")


STREET = """named_struct('id', CASE WHEN event_id % 13 <> 12 THEN CAST(event_id AS STRING) END, 'captured_at', event_id * 173000001L,
    'compass_angle', value, 'computed_compass_angle', CASE WHEN event_id % 3 = 0 THEN value * 2 END, 'geometry', named_struct('coordinates',
    array(value, 1e0)), 'computed_geometry', CASE WHEN event_id % 2 = 0 THEN named_struct('coordinates', array(value / 2, 2e0)) END, 'creator',
    named_struct('username', event_type), 'thumb_1024_url', CASE WHEN event_id % 5 <> 4 THEN 't' || event_id END, 'width', 640, 'height', 480)"""


@query("normalize_mapillary", """SELECT 'mapillary-' || event_id AS id, CASE WHEN DATE '1970-01-01' + CAST(floor(event_id * 173000001 / 86400000e0) AS
    INT) <= DATE '2026-09-17' THEN CAST(DATE '1970-01-01' + CAST(floor(event_id * 173000001 / 86400000e0) AS INT) AS VARCHAR) END AS date_taken,
    round_even(CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END % 360, 1) AS heading_deg, CASE WHEN event_id % 2 = 0 THEN 2e0 ELSE 1e0 END
    AS lat, round(CASE WHEN event_id % 2 = 0 THEN value / 2 ELSE value END, 6) AS lng, event_type AS author FROM events WHERE event_id % 5 <> 4 AND
    event_id % 13 <> 12""")
def normalize_mapillary(spark, sf_dir):
    payloads = views.table(spark, sf_dir, "events").selectExpr(
        "user_id AS profile_id", "event_id AS seq", f"to_json({STREET}) AS payload")
    rows = images.normalize_mapillary(payloads, _today())
    return rows.select("id", "date_taken", "heading_deg", "lat", F.round("lng", 6).alias("lng"), "author")


OPENVERSE = """named_struct('id', CAST(doc_id AS STRING), 'url', 'https://i/' || doc_id, 'foreign_landing_url', CASE WHEN doc_id % 9 <> 8 THEN
    'https://WWW.Host' || doc_id % 4 || '.org/p' END, 'title', 'Gate ' || (1990 + doc_id % 60), 'attribution', text, 'creator', CASE WHEN doc_id %
    2 = 0 THEN lang ELSE '' END, 'license', 'by-sa', 'license_version', CASE WHEN doc_id % 3 = 0 THEN '4.0' END)"""


@query("normalize_openverse", """SELECT 'openverse-' || doc_id AS id, 'www.host' || doc_id % 4 || '.org' AS source_domain, CASE WHEN doc_id % 3 = 0
    THEN 'BY-SA 4.0' ELSE 'BY-SA' END AS license, CASE WHEN doc_id % 2 = 0 THEN lang END AS author, CASE WHEN 1990 + doc_id % 60 <= 2026 THEN 1990 +
    doc_id % 60 END AS hint, CASE WHEN 1990 + doc_id % 60 <= 2026 THEN 'text_hint' ELSE 'unknown' END AS date_source, md5(text) AS digest FROM
    documents WHERE doc_id % 9 <> 8""")
def normalize_openverse(spark, sf_dir):
    rows = images.normalize_openverse(_payload(_docs(spark, sf_dir), OPENVERSE), _today())
    return rows.select("id", "source_domain", "license", "author", F.col("date_hint_year").alias("hint"), "date_source",
                       F.md5(F.col("description").cast("binary")).alias("digest"))


WEB = """named_struct('title', title_text, 'url', CASE WHEN page_id % 8 = 7 THEN 'ftp://x/' ELSE url END, 'thumbnail', named_struct('src',
    'https://t/' || page_id), 'properties', named_struct('url', CASE WHEN page_id % 2 = 0 THEN 'https://i/' || (page_id DIV 4) END, 'width', 150 +
    page_id % 90, 'height', 400))"""


@query("normalize_web_search", r"""SELECT page_id, 'web-' || left(sha1(CASE WHEN page_id % 2 = 0 THEN 'https://i/' || page_id // 4 ELSE
    'https://t/' || page_id END), 12) AS id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source_domain, md5(html) AS digest FROM pages WHERE
    page_id % 8 <> 7 AND 150 + page_id % 90 >= 200""")
def normalize_web_search(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").withColumn("title_text", F.col("html"))
    payloads = pages.selectExpr("page_id % 25 AS profile_id", "page_id AS seq", f"to_json({WEB}) AS payload")
    rows = images.normalize_web_search(payloads)
    return rows.select(F.col("seq").alias("page_id"), "id", "source_domain", F.md5(F.col("title").cast("binary")).alias("digest"))


@query("extract_page_images", r"""SELECT 'site-' || left(sha1(regexp_extract(url, '^[a-z]+://[^/?#]+') || '/img/' || page_id || '_library.jpg'), 12)
    AS id, page_id, '2021-03' AS date_taken FROM pages""")
def extract_page_images(spark, sf_dir):
    """The given pages declare no images, so each whole page gets one relative image and one dated image object in front."""
    key = F.col("page_id").cast("string")
    origin = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    head = F.concat(
        F.lit('<meta property="og:image" content="/img/'), key, F.lit('_library.jpg"><img src="/x.svg" alt="campus library">'),
        F.lit('<script type="application/ld+json">{"@graph": [{"@type": "ImageObject", "contentUrl": "'), origin, F.lit("/img/"), key,
        F.lit('_library.jpg", "dateCreated": "2021-03"}]}</script>'))
    pages = views.table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 25).alias("profile_id"), F.col("page_id").alias("seq"), "url", F.concat(head, F.col("html")).alias("html"))
    rows = site.extract_page_images(pages, _today())
    return rows.select("id", F.shiftright("seq", 32).alias("page_id"), "date_taken")


@query("sitemap_links", """SELECT p_size AS site_id, 'https://s' || p_size || '/campus/' || p_partkey AS link, position FROM (SELECT *, row_number()
    OVER (PARTITION BY p_size ORDER BY '20' || (10 + p_partkey % 16) || '-01-01' DESC, p_partkey::VARCHAR DESC) AS position FROM part WHERE
    p_partkey % 3 <> 0) WHERE position <= 8""")
def sitemap_links(spark, sf_dir):
    """One site map per part; the maps of a size belong to one site."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    link = F.concat(F.lit("https://s"), size, F.when(F.col("p_partkey") % 3 == 0, "/news/").otherwise("/campus/"), key)
    xml = F.concat(F.lit("<urlset>\n<url><loc>"), link, F.lit("</loc><lastmod>20"), (F.lit(10) + F.col("p_partkey") % 16).cast("string"),
                   F.lit("-01-01</lastmod></url></urlset>"))
    return site.sitemap_links(views.table(spark, sf_dir, "part").select(F.col("p_size").alias("site_id"), xml.alias("xml"))).select(
        "site_id", "link", "position")


def _ring_points(cx: str, cy: str) -> str:
    corners = [("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"), ("-", "-")]
    return "array(" + ", ".join(f"named_struct('lon', {cx} {a} 1e-4, 'lat', {cy} {b} 1e-4)" for a, b in corners) + ")"


ELEMENT = f"""named_struct('type', 'way', 'id', p_partkey, 'tags', CASE WHEN p_partkey % 6 = 5 THEN map('highway', 'path') ELSE map('building',
    CASE p_partkey % 3 WHEN 0 THEN 'dormitory' WHEN 1 THEN 'university' ELSE 'yes' END, 'name', p_name, 'height', CASE p_partkey % 4 WHEN 0 THEN
    '22.5 m' WHEN 1 THEN '7,5' WHEN 2 THEN 'tall' ELSE '12m' END, 'building:levels', CAST(p_size AS STRING)) END, 'geometry', CASE WHEN p_partkey
    % 8 = 7 THEN slice({_ring_points('p_size * 1e-3', '1e0')}, 1, 4) ELSE {_ring_points('p_size * 1e-3', '1e0')} END)"""


def _elements(spark, sf_dir):
    payloads = views.table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 25 AS profile_id", "p_partkey AS seq", f"to_json({ELEMENT}) AS payload")
    return maps.read_elements(payloads)


@query("normalize_buildings", """SELECT 'way-' || p_partkey AS building_id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'dorm' WHEN 1 THEN 'academic'
    ELSE 'other' END AS type, CASE p_partkey % 4 WHEN 0 THEN 22.5e0 WHEN 1 THEN 7.5e0 WHEN 3 THEN 12e0 END AS height_m, p_size AS levels,
    round(p_size * 1e-3 - 1e-4, 6) AS first_x FROM part WHERE p_partkey % 6 <> 5 AND p_partkey % 8 <> 7""")
def normalize_buildings(spark, sf_dir):
    rows = maps.normalize_buildings(_elements(spark, sf_dir))
    return rows.select("building_id", "name", "type", "height_m", "levels", F.round(F.col("ring")[0]["x"], 6).alias("first_x"))


def _line(*corners: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('lon', {x}, 'lat', {y})" for x, y in corners) + ")"


def _member(role: str, line: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN named_struct('type', 'way', 'role', '{role}', 'geometry', {line}) END"


def _box_line(x: str, y: str, size: str) -> str:
    return _line((x, y), (f"{x} + {size}", y), (f"{x} + {size}", f"{y} + {size}"), (x, f"{y} + {size}"), (x, y))


# A box drawn by three open ways, one of them missing in every fourth; a closed second part, a hole, a loose end.
X0, WIDE, HIGH = "p_size * 1e-2", "p_size * 1e-2 + 1e-3 * (1 + p_partkey % 3)", "1e0 + 1e-3"
RELATION = "named_struct('type', 'relation', 'id', p_partkey, 'tags', map('amenity', 'university', 'name', p_name), 'members', array(" + ", ".join([
    _member("outer", _line((X0, "1e0"), (WIDE, "1e0"), (WIDE, HIGH))), _member("inner", _box_line(f"{X0} + 2e-4", "1e0 + 2e-4", "1e-4"), "p_partkey % 5 = 0"),
    _member("outer", _line((X0, "1e0"), (X0, HIGH)), "p_partkey % 4 <> 0"), _member("perimeter", _line((X0, HIGH), (WIDE, HIGH))),
    _member("", _box_line(f"{X0} + 5e-3", "1e0", "2e-3"), "p_partkey % 3 = 0"), _member("outer", _line((X0, "1e0"), (X0, "5e-1")), "p_partkey % 2 = 0")]) + "))"


@query("join_outlines", """SELECT p_partkey AS element_id, CAST((p_partkey % 4 <> 0) AS INT) + CAST((p_partkey % 3 = 0) AS INT) AS parts, round(CASE
    WHEN p_partkey % 4 <> 0 THEN 1e0 + p_partkey % 3 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 4e0 ELSE 0 END, 3) AS area, round(p_size * 1e-2 +
    CASE WHEN p_partkey % 3 = 0 THEN 5e-3 ELSE 0 END, 6) AS largest_w, p_partkey % 4 <> 0 AS holds_first, p_partkey % 3 = 0 AS holds_second
    FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 3 = 0""")
def join_outlines(spark, sf_dir):
    # Joining ways is long work on short rows: one file split may hold a million of them, so they are dealt out first, to a given
    # number of partitions, which adaptive execution leaves as they are.
    parts = views.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    payloads = parts.selectExpr(
        "p_partkey % 25 AS profile_id", "p_partkey AS seq", f"to_json({RELATION}) AS payload", "p_size * 1e-2 AS x0")
    rows = maps.campus_elements(maps.read_elements(payloads)).withColumn("edges", F.flatten(F.transform("parts", geo.edges_of)))
    measured = rows.select(
        "element_id", F.size("parts").alias("parts"), F.round(geo.planar_area(F.col("edges")) * 1e6, 3).alias("area"),
        F.round(geo.bbox_of(F.col("ring"))["w"], 6).alias("largest_w"), "edges")
    at = payloads.select(F.col("seq").alias("element_id"), "x0")
    return measured.join(at, "element_id").select(
        "element_id", "parts", "area", "largest_w",
        geo.contains(F.col("edges"), F.col("x0") + 2.5e-4, F.lit(1.00025)).alias("holds_first"),
        geo.contains(F.col("edges"), F.col("x0") + 6e-3, F.lit(1.001)).alias("holds_second"))


THICK = "1e-4 * (1 + p_partkey % 3)"
ELL = _line((X0, "1e0"), (f"{X0} + 3 * {THICK}", "1e0"), (f"{X0} + 3 * {THICK}", f"1e0 + {THICK}"), (f"{X0} + {THICK}", f"1e0 + {THICK}"),
            (f"{X0} + {THICK}", f"1e0 + 3 * {THICK}"), (X0, f"1e0 + 3 * {THICK}"), (X0, "1e0"))
CROSSED = _line((X0, "1e0"), (f"{X0} + 1e-4", "1e0 + 1e-4"), (f"{X0} + 1e-4", "1e0"), (X0, "1e0 + 1e-4"), (X0, "1e0"))


@query("interior_points", """SELECT 'way-' || p_partkey AS building_id, round(p_size * 1e-2 + 5e-5 * (1 + p_partkey % 3), 6) AS x,
    round(1e0 + 2e-4 * (1 + p_partkey % 3), 6) AS y FROM part WHERE p_partkey % 7 <> 0""")
def interior_points(spark, sf_dir):
    payloads = views.table(spark, sf_dir, "part").selectExpr("p_partkey % 25 AS profile_id", "p_partkey AS seq", f"""to_json(named_struct('type', 'way',
        'id', p_partkey, 'tags', map('building', 'yes'), 'geometry', CASE WHEN p_partkey % 7 = 0 THEN {CROSSED} ELSE {ELL} END)) AS payload""")
    point = geo.interior_point(geo.edges_of(F.col("ring")))
    return maps.normalize_buildings(maps.read_elements(payloads)).select(
        "building_id", F.round(point["x"], 6).alias("x"), F.round(point["y"], 6).alias("y"))


BINDING = """named_struct('item', named_struct('value', 'http://e/Q' || s_suppkey % 40), 'itemLabel', named_struct('value', 'Hall ' || s_suppkey %
    40 || ' ' || s_suppkey % 3), 'coord', named_struct('value', 'Point(' || (127 + s_suppkey % 4) || '.5 ' || '37.25)'), 'image',
    named_struct('value', 'http://c/My_file_' || s_suppkey % 2 || '.jpg'), 'commons', CASE WHEN s_suppkey % 5 = 0 THEN named_struct('value', 'Cat '
    || s_suppkey) END, 'instance', named_struct('value', 'http://e/' || CASE s_suppkey % 3 WHEN 0 THEN 'Q7075' ELSE 'Q1' END), 'direct', CASE WHEN
    s_suppkey % 7 = 0 THEN named_struct('value', 'true') END)"""


@query("discover_subjects", """WITH k AS (SELECT s_nationkey % 2 AS profile_id, s_suppkey AS seq, 'Q' || s_suppkey % 40 AS qid, 'Hall ' || s_suppkey %
    40 || ' ' || s_suppkey % 3 AS label, CASE WHEN s_suppkey % 5 = 0 THEN 'Cat ' || s_suppkey END AS category, CASE WHEN s_suppkey % 3 = 0 THEN
    'library' END AS kind FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 4 < 2), first AS (SELECT profile_id, qid, label, min(seq) AS s FROM
    k GROUP BY ALL), l AS (SELECT profile_id, qid, string_agg(label, '|' ORDER BY s) AS names FROM first GROUP BY ALL), g AS (SELECT profile_id,
    qid, min(seq) AS ord, arg_max(category, seq) FILTER (category IS NOT NULL) AS category, coalesce(max(kind), 'other') AS building_type FROM k
    GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY ord) AS n FROM g) SELECT profile_id, qid, names, category,
    building_type FROM top JOIN l USING (profile_id, qid) WHERE n <= 20""")
def discover_subjects(spark, sf_dir):
    payloads = views.table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_nationkey % 2 AS BIGINT) AS profile_id", "s_suppkey AS seq", f"to_json({BINDING}) AS payload")
    box = geo.bbox(F.lit(127.0), F.lit(37.0), F.lit(129.0), F.lit(38.0))
    boxes = payloads.select("profile_id").distinct().withColumn("box", box)
    rows = maps.discover_subjects(payloads, boxes)
    return rows.select("profile_id", "qid", F.array_join("names", "|").alias("names"), "category", "building_type")
