"""Image payloads of five sources (JSON text in `payload`) to image rows. Input: profile_id, seq, payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.functions import dates, geo, text
from placeproof.schemas import as_images

# Fixed values.
MIN_SIDE_PX = 200
PHOTO_TYPES = ["image/jpeg", "image/png", "image/webp"]
LICENSES = {
    "1": ("CC BY-NC-SA 2.0", "https://creativecommons.org/licenses/by-nc-sa/2.0/"),
    "2": ("CC BY-NC 2.0", "https://creativecommons.org/licenses/by-nc/2.0/"),
    "3": ("CC BY-NC-ND 2.0", "https://creativecommons.org/licenses/by-nc-nd/2.0/"),
    "4": ("CC BY 2.0", "https://creativecommons.org/licenses/by/2.0/"),
    "5": ("CC BY-SA 2.0", "https://creativecommons.org/licenses/by-sa/2.0/"),
    "6": ("CC BY-ND 2.0", "https://creativecommons.org/licenses/by-nd/2.0/"),
    "9": ("CC0 1.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    "10": ("Public Domain Mark 1.0", "https://creativecommons.org/publicdomain/mark/1.0/"),
    "11": ("CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/"),
    "12": ("CC BY-SA 4.0", "https://creativecommons.org/licenses/by-sa/4.0/"),
    "13": ("CC BY-ND 4.0", "https://creativecommons.org/licenses/by-nd/4.0/"),
    "14": ("CC BY-NC 4.0", "https://creativecommons.org/licenses/by-nc/4.0/"),
    "15": ("CC BY-NC-SA 4.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    "16": ("CC BY-NC-ND 4.0", "https://creativecommons.org/licenses/by-nc-nd/4.0/"),
}
FULL_SIZES, THUMB_SIZES = ["o", "k", "h", "l", "c", "z"], ["z", "m"]
STREET_LICENSE = ("CC BY-SA 4.0", "https://creativecommons.org/licenses/by-sa/4.0/")
COMMONS = """pageid bigint, title string, structured_date string, coordinates array<struct<lat:double,lon:double>>,
imageinfo array<struct<url:string,thumburl:string,descriptionurl:string,mime:string,sha1:string,timestamp:string,
width:int,height:int,metadata:array<struct<name:string,value:string>>,extmetadata:map<string,struct<value:string>>>>"""
FLICKR = (
    "id string, owner string, title string, license string, description string, dateupload string, datetaken string,"
    "datetakenunknown string, ownername string, latitude string, longitude string, tags string, media string,"
    + ",".join(f"url_{s} string, width_{s} string, height_{s} string" for s in dict.fromkeys([*FULL_SIZES, *THUMB_SIZES])))
STREET = """id string, captured_at bigint, compass_angle double, computed_compass_angle double, width int, height int,
geometry struct<coordinates:array<double>>, computed_geometry struct<coordinates:array<double>>,
creator struct<username:string>, thumb_1024_url string, thumb_original_url string"""
OPENVERSE = """id string, url string, foreign_landing_url string, thumbnail string, title string, attribution string,
creator string, license string, license_version string, license_url string, width int, height int"""
WEB = """title string, description string, url string, source string, thumbnail struct<src:string>,
properties struct<url:string,placeholder:string,width:int,height:int>"""


def filter_min_side(df: DataFrame, px: int = MIN_SIDE_PX) -> DataFrame:
    """Unknown sizes pass; known ones need both sides of at least `px`."""
    known = (F.coalesce("width", F.lit(0)) != 0) & (F.coalesce("height", F.lit(0)) != 0)
    return df.filter(~known | (F.least("width", "height") >= px))


def _read(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.select("profile_id", "seq", F.from_json("payload", schema).alias("p")).select("profile_id", "seq", "p.*")


def _blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def normalize_commons(payloads: DataFrame, today: Column) -> DataFrame:
    """Media repository pages: photos only; capture date by trust: camera, structured claim, source text."""
    page = _read(payloads, COMMONS).withColumn("i", F.get("imageinfo", F.lit(0)))
    info, meta = F.col("i"), F.col("i.extmetadata")

    def ext(key: str) -> Column:
        return F.element_at(meta, F.lit(key))["value"]

    def camera(key: str) -> Column:
        named = F.filter(F.col("i.metadata"), lambda m: m["name"] == key)
        return _blank_to_null(F.get(named, F.size(named) - 1)["value"])

    kept = filter_min_side(page.filter(info["mime"].isin(PHOTO_TYPES) & info["url"].isNotNull()).withColumns({
        "width": info["width"], "height": info["height"]}))
    exif = dates.messy_date(F.coalesce(camera("DateTimeOriginal"), camera("DateTimeDigitized")), today)
    stated = dates.messy_date(text.strip_tags(ext("DateTimeOriginal")), today)
    structured = F.col("structured_date")
    dated = kept.withColumns({
        "exif": exif, "stated": stated, "date_uploaded": dates.messy_date(info["timestamp"], today),
        "description": text.clean_html(ext("ImageDescription")), "artist": text.clean_html(ext("Artist"))})
    taken = F.coalesce("exif", structured, "stated")
    source = (F.when(F.col("exif").isNotNull(), "exif").when(structured.isNotNull(), "structured_data")
              .when(F.col("stated").isNotNull(), "source_metadata")
              .when(F.col("date_uploaded").isNotNull(), "upload_only").otherwise("unknown"))
    point = F.get("coordinates", F.lit(0))
    return as_images(dated.select(
        "profile_id", "seq", F.concat(F.lit("commons-"), F.col("pageid")).alias("id"),
        F.lit("wikimedia_commons").alias("source"),
        F.coalesce(_blank_to_null(info["descriptionurl"]), F.concat(
            F.lit("https://commons.wikimedia.org/?curid="), F.col("pageid"))).alias("source_url"),
        F.lit("commons.wikimedia.org").alias("source_domain"), info["url"].alias("full_url"),
        info["thumburl"].alias("thumb_url"), "title", "description",
        F.filter(F.split(F.coalesce(ext("Categories"), F.lit("")), r"\|"), lambda c: c != "").alias("source_categories"),
        F.nullif(_blank_to_null(F.col("artist")), F.lit("—")).alias("author"),
        _blank_to_null(text.clean_html(ext("LicenseShortName"))).alias("license"),
        _blank_to_null(text.clean_html(ext("LicenseUrl"))).alias("license_url"), taken.alias("date_taken"),
        "date_uploaded", source.alias("date_source"),
        dates.text_year(today, F.col("title"), F.col("description")).alias("date_hint_year"),
        point["lat"].alias("lat"), point["lon"].alias("lng"), "width", "height",
        _blank_to_null(info["sha1"]).alias("sha1")))


def with_license(rows: DataFrame, code: str = "license") -> DataFrame:
    """Licence name and link by code; rows with another code are dropped. A literal map, so nothing is shuffled."""
    table = F.create_map(*[x for k, (n, u) in LICENSES.items() for x in (
        F.lit(k), F.struct(F.lit(n).alias("name"), F.lit(u).alias("url")))])
    return rows.withColumn("_l", F.element_at(table, F.col(code))).filter(F.col("_l").isNotNull()).withColumns({
        "license": F.col("_l.name"), "license_url": F.col("_l.url")}).drop("_l")


def normalize_flickr(payloads: DataFrame, today: Column) -> DataFrame:
    """Photo host items: listed licences, the largest size, and a capture date only when it is a real one."""
    def first(names: list[str]) -> Column:
        return F.coalesce(*[_blank_to_null(F.col(n)) for n in names])

    def of_largest(field: str) -> Column:
        return reduce(lambda acc, s: F.when(_blank_to_null(F.col(f"url_{s}")).isNotNull(), F.col(f"{field}_{s}")).otherwise(acc),
                      reversed(FULL_SIZES), F.lit(None).cast("string")).try_cast("double").cast("int")

    rows = with_license(_read(payloads, FLICKR)).withColumns({
        "full_url": first([f"url_{s}" for s in FULL_SIZES]), "thumb_url": first([f"url_{s}" for s in THUMB_SIZES]),
        "width": of_largest("width"), "height": of_largest("height"),
        "lat": F.col("latitude").try_cast("double"), "lng": F.col("longitude").try_cast("double"),
        "date_uploaded": dates.unix_date(F.col("dateupload"), today),
        "taken": dates.normalize_date(F.left(F.coalesce("datetaken", F.lit("")), F.lit(10)), today)})
    kept = filter_min_side(rows.filter(
        F.col("full_url").isNotNull() & (F.coalesce("media", F.lit("photo")) == "photo")))
    invented = (F.coalesce("datetakenunknown", F.lit("0")) == "1") | F.col("taken").eqNullSafe(F.col("date_uploaded"))
    nowhere = F.coalesce((F.col("lat") == 0) & (F.col("lng") == 0), F.lit(False))
    body = F.when(F.col("description").startswith("{"), F.get_json_object("description", "$._content")).otherwise(
        F.col("description"))
    return as_images(kept.withColumns({
        "date_taken": F.when(~invented, F.col("taken")), "body": F.coalesce(body, F.lit(""))}).select(
        "profile_id", "seq", F.concat(F.lit("flickr-"), F.col("id")).alias("id"), F.lit("flickr").alias("source"),
        F.concat(F.lit("https://www.flickr.com/photos/"), F.coalesce("owner", F.lit("")), F.lit("/"), F.col("id"))
        .alias("source_url"), F.lit("www.flickr.com").alias("source_domain"), "full_url", "thumb_url", "title",
        text.strip_tags(F.col("body")).alias("description"),
        F.filter(F.split(F.coalesce("tags", F.lit("")), r"\s+"), lambda t: t != "").alias("source_categories"),
        F.lit("bbox").alias("found_by"), _blank_to_null(F.col("ownername")).alias("author"), "license", "license_url",
        "date_taken", "date_uploaded",
        F.when(F.col("date_taken").isNotNull(), "source_metadata").when(F.col("date_uploaded").isNotNull(), "upload_only")
        .otherwise("unknown").alias("date_source"),
        dates.text_year(today, F.col("title"), F.col("body")).alias("date_hint_year"),
        F.when(~nowhere, F.col("lat")).alias("lat"), F.when(~nowhere, F.col("lng")).alias("lng"), "width", "height"))


def normalize_mapillary(payloads: DataFrame, today: Column) -> DataFrame:
    """Street-level images: computed geometry and angle preferred, one fixed licence."""
    rows = _read(payloads, STREET).withColumns({
        "point": F.coalesce("computed_geometry.coordinates", "geometry.coordinates"),
        "full_url": F.coalesce(_blank_to_null(F.col("thumb_original_url")), _blank_to_null(F.col("thumb_1024_url"))),
        "date_taken": dates.unix_date(F.col("captured_at"), today, millis=True)}).filter(
        F.col("full_url").isNotNull() & F.col("id").isNotNull())
    return as_images(rows.select(
        "profile_id", "seq", F.concat(F.lit("mapillary-"), F.col("id")).alias("id"), F.lit("mapillary").alias("source"),
        F.concat(F.lit("https://www.mapillary.com/app/?pKey="), F.col("id")).alias("source_url"),
        F.lit("www.mapillary.com").alias("source_domain"), "full_url", F.col("thumb_1024_url").alias("thumb_url"),
        F.lit("bbox").alias("found_by"), _blank_to_null(F.col("creator.username")).alias("author"),
        F.lit(STREET_LICENSE[0]).alias("license"), F.lit(STREET_LICENSE[1]).alias("license_url"), "date_taken",
        F.when(F.col("date_taken").isNotNull(), "source_metadata").otherwise("unknown").alias("date_source"),
        F.get("point", F.lit(1)).alias("lat"), F.get("point", F.lit(0)).alias("lng"),
        geo.heading(F.coalesce("computed_compass_angle", "compass_angle")).alias("heading_deg"), "width", "height"))


def normalize_openverse(payloads: DataFrame, today: Column) -> DataFrame:
    """Open-licence index items; the index date is never a photo date."""
    rows = _read(payloads, OPENVERSE).filter(
        (F.col("url") != "") & (F.col("foreign_landing_url") != "") & (F.col("id") != "")).withColumn(
        "date_hint_year", dates.text_year(today, F.col("title")))
    license = F.concat_ws(" ", F.upper(F.coalesce("license", F.lit(""))), _blank_to_null(F.col("license_version")))
    return as_images(rows.select(
        "profile_id", "seq", F.concat(F.lit("openverse-"), F.col("id")).alias("id"), F.lit("openverse").alias("source"),
        F.col("foreign_landing_url").alias("source_url"),
        F.coalesce(text.host_of(F.col("foreign_landing_url")), F.lit("openverse.org")).alias("source_domain"),
        F.col("url").alias("full_url"), F.col("thumbnail").alias("thumb_url"), "title",
        F.coalesce("attribution", F.lit("")).alias("description"), F.lit("openverse").alias("found_by"),
        _blank_to_null(F.col("creator")).alias("author"), _blank_to_null(license).alias("license"),
        _blank_to_null(F.col("license_url")).alias("license_url"), "date_hint_year",
        F.when(F.col("date_hint_year").isNotNull(), "text_hint").otherwise("unknown").alias("date_source"), "width",
        "height"))


def normalize_web_search(payloads: DataFrame) -> DataFrame:
    """Image search items; the id depends on the image address only, so an image on several pages is one photo."""
    rows = _read(payloads, WEB).withColumn("full_url", F.coalesce(
        _blank_to_null(F.col("properties.url")), _blank_to_null(F.col("thumbnail.src")))).withColumns({
            "width": F.col("properties.width"), "height": F.col("properties.height")}).filter(
        F.col("full_url").isNotNull() & F.col("url").rlike("(?i)^https?:"))
    return as_images(filter_min_side(rows).select(
        "profile_id", "seq", text.content_id("web-", F.col("full_url")).alias("id"), F.lit("web_search").alias("source"),
        F.col("url").alias("source_url"),
        F.coalesce(text.host_of(F.col("url")), _blank_to_null(F.col("source")), F.lit("unknown")).alias("source_domain"),
        "full_url", F.coalesce(_blank_to_null(F.col("thumbnail.src")), F.col("properties.placeholder")).alias("thumb_url"),
        "title", "description", F.lit("text").alias("found_by"), "width", "height"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All image rows under one schema."""
    return reduce(DataFrame.unionByName, [as_images(s) for s in sources])
