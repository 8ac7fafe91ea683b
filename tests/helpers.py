"""Fixtures shared by the tests: one square campus with a library, and image rows with defaults."""

import json

from pyspark.sql import functions as F

from placeproof import schemas

RING = [(127.027, 37.584), (127.037, 37.584), (127.037, 37.594), (127.027, 37.594), (127.027, 37.584)]
LIBRARY = [(127.030, 37.588), (127.031, 37.588), (127.031, 37.589), (127.030, 37.589), (127.030, 37.588)]
NAMES = ["Korea University", "고려대학교", "KU"]
INSIDE = {"lat": 37.590, "lng": 127.034}
IN_LIBRARY = {"lat": 37.5885, "lng": 127.0305}
STREET = {**INSIDE, "title": "Street view"}


def campus(spark, names=NAMES, ring=RING, profile_id=1):
    return spark.createDataFrame([(profile_id, names, 37.589, 127.032, ring, ["korea.ac.kr"])], schemas.CAMPUS)


def buildings(spark):
    return spark.createDataFrame(
        [(1, 0, "b1", "Central Library", "library", LIBRARY, None, None, True)], schemas.BUILDINGS)


def images(spark, rows):
    base = {
        "profile_id": 1, "source": "wikimedia_commons", "source_domain": "commons.wikimedia.org", "title": "File:Campus view.jpg",
        "full_url": "https://upload/campus.jpg", "author": "Someone", "license": "CC BY-SA 4.0", "date_taken": "2024-05-01",
        "vision_checked": True, "sha1": "aaa"}
    lines = [json.dumps({**base, "seq": i, "id": f"i{i}", **row}) for i, row in enumerate(rows)]
    parsed = spark.createDataFrame([(line,) for line in lines], "line string").select(
        F.from_json("line", schemas.RAW_IMAGES).alias("r")).select("r.*")
    return schemas.as_images(parsed)
