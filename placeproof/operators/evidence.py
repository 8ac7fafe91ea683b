"""Evidence, confidence, tier, category and tags of image rows; one pass of native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.functions import dates, rules, text
from placeproof.functions.labels import building_type_name, format_distance, label
from placeproof.operators import spatial

# Fixed values.
BASE_CONFIDENCE, VERIFIED_FROM, LIKELY_FROM = 40, 80, 60
UNCONFIRMED_MAX = LIKELY_FROM - 1
CATEGORY_WEIGHT, SUBCATEGORY_WEIGHT, BUILDING_WEIGHT = 22, 16, 6
NAME_WEIGHT, OFFICIAL_WEIGHT, NO_LICENSE_WEIGHT = 14, 30, -12
PEOPLE_WEIGHT, SPECIMEN_WEIGHT, INSTITUTION_WEIGHT = -15, -15, -20
PLACE_TYPES = ["geo", "category", "text"]
ROOM_CATEGORIES = ["dorms", "classrooms", "libraries"]
BUILDING_CATEGORIES = {"library": "libraries", "dorm": "dorms"}
BUILDING_TAGS = {"dorm": "dorm", "sport": "sport", "lab": "labs"}
SUBJECT_CATEGORIES = {"dorm": "dorms", "library": "libraries", "academic": "classrooms"}


def own_text() -> Column:
    return F.concat(F.col("title"), F.lit(" "), F.col("description"))


OWN_RULES = [rules.NOT_A_PHOTO, rules.OTHER_INSTITUTION, rules.SHOWCASE]
ALL_RULES = [
    rules.PEOPLE_OR_EVENT, rules.SPECIMEN, rules.FOOD_CLOSEUP, rules.LIBRARY, rules.DORM, rules.CLASSROOM, rules.SPORT, rules.LAB,
    rules.STUDENT_LIFE]


def with_texts(images: DataFrame) -> DataFrame:
    """Lower-cased texts that the rules read, and the signs of rules' words in them; each is built once per row."""
    # Joined of lowered parts: a space between two letters keeps them from changing each other's case.
    texts = images.withColumns({"_title": F.lower("title"), "_desc": F.lower("description")}).withColumns({
        "_own": F.concat("_title", F.lit(" "), "_desc"),
        "_all": F.concat_ws(" ", "_title", "_desc", F.transform("source_categories", F.lower))})
    # All text goes on where the own one ends, so only its last words are read again: what lies across the border begins in them.
    tail = F.substring_index("_own", " ", -rules.most_spaces(*ALL_RULES) - 1)
    rest = F.when(F.col("_own").isNull(), F.col("_all")).otherwise(F.concat_ws(" ", tail, F.transform("source_categories", F.lower)))
    return texts.withColumns({
        "_own_signs": rules.signs_in(F.col("_own"), *OWN_RULES, *ALL_RULES), "_rest_signs": rules.signs_in(rest, *ALL_RULES)}).withColumn(
        "_all_signs", F.concat_ws("\n", "_own_signs", "_rest_signs")).drop("_rest_signs")


def places(images: DataFrame) -> DataFrame:
    """Images with their texts, without those that are no photo of a place.

    Generated rather than filtered: a filter would move before the texts and their signs, and so build them twice.
    """
    kept = F.when(~not_a_place(), F.array(F.lit(True)))
    return with_texts(images).withColumn("_kept", F.explode(kept)).drop("_kept")


def not_a_place() -> Column:
    return rules.matches("_own", rules.NOT_A_PHOTO, "_own_signs") | rules.any_matches(
        F.col("source_categories"), rules.NOT_A_PHOTO_CATEGORY)


def people_or_event() -> Column:
    return (
        rules.matches("_all", rules.PEOPLE_OR_EVENT, "_all_signs")
        | rules.matches("_title", rules.GROUP_OF_PEOPLE)
        | rules.any_matches(
            F.col("source_categories"), rules.GROUP_OF_PEOPLE, rules.PERSON_CATEGORY, rules.EVENT_CATEGORY)
    )


def specimen() -> Column:
    return rules.matches("_all", rules.SPECIMEN, "_all_signs") | rules.any_matches(
        F.col("source_categories"), rules.SPECIMEN_CATEGORY)


def food_closeup() -> Column:
    return rules.matches("_all", rules.FOOD_CLOSEUP, "_all_signs")


def other_institution(names: Column, held: Column | None = None) -> Column:
    """The word or category that names a different institution, or null; `held` tells whether the text has such a word, if that is known."""
    own = F.transform(F.filter(names, lambda n: F.length(n) >= 4), F.lower)
    categories = F.array_compact(F.concat(F.array(F.nullif("matched_category", F.lit(""))), F.col("source_categories")))
    in_category = F.get(F.filter(categories, lambda c: F.lower(c).rlike(rules.pattern(rules.OTHER_INSTITUTION)) & ~F.exists(
        own, lambda n: F.contains(F.lower(c), n))), F.lit(0))
    return F.when(~rules.any_matches(names, rules.OTHER_INSTITUTION), F.coalesce(
        rules.found_word(own_text(), rules.OTHER_INSTITUTION, held), in_category))


def official_domain(domains: Column) -> Column:
    host = text.without_www(F.col("source_domain"))
    listed = F.exists(domains, lambda d: (d != "") & (
        (host == text.without_www(d)) | host.endswith(F.concat(F.lit("."), text.without_www(d)))))
    return F.when(F.coalesce(listed, F.lit(False)) | F.col("is_official_site"), F.col("source_domain"))


def text_category() -> Column:
    return (
        F.when(rules.matches("_all", rules.LIBRARY, "_all_signs"), "libraries")
        .when(rules.matches("_all", rules.DORM, "_all_signs"), "dorms")
        .when(rules.matches("_all", rules.CLASSROOM, "_all_signs"), "classrooms")
    )


def text_tags() -> Column:
    """Tags from the text; a lab counts by title, or by description or category when the file is not about people."""
    lab = rules.matches("_title", rules.LAB) | (~F.col("people") & (
        rules.matches("_desc", rules.LAB, "_all_signs") | rules.any_matches(F.col("source_categories"), rules.LAB)))
    return F.array_compact(F.array(
        F.when(rules.matches("_all", rules.DORM, "_all_signs"), "dorm"),
        F.when(rules.matches("_all", rules.SPORT, "_all_signs"), "sport"),
        F.when(lab, "labs"),
        F.when(rules.matches("_all", rules.STUDENT_LIFE, "_all_signs"), "student_life")))


def _choose(value: Column, options: dict[str, str]) -> Column:
    out = None
    for key, result in options.items():
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return out


def classify() -> tuple[Column, Column]:
    """(category, tags), from the most reliable sign down. Reads the columns that `score` prepares."""
    sub = F.when(F.col("matched_subcategory"), F.lower("matched_category"))
    category = F.coalesce(
        F.when(rules.matches(sub, rules.LIBRARY), "libraries").when(rules.matches(sub, rules.DORM), "dorms"),
        _choose(F.col("building.type"), BUILDING_CATEGORIES),
        F.col("text_category"),
        F.when(F.col("off_campus") & ~F.col("linked"), "city").otherwise("campus"))
    on_ground = ~F.col("off_campus")
    room = F.when(F.col("vision_category").isin(ROOM_CATEGORIES) & on_ground, F.col("vision_category"))
    subject = F.when(on_ground, _choose(F.col("subject_building_type"), SUBJECT_CATEGORIES))
    building_tag = F.array_compact(F.array(_choose(F.col("building.type"), BUILDING_TAGS)))
    return F.coalesce(subject, room, category), F.array_distinct(F.concat(building_tag, F.col("text_tags")))


def item(kind: str, words: Column, weight: Column | int) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), words.alias("label"),
        (F.lit(weight) if isinstance(weight, int) else weight).cast("int").alias("weight"))


def build_evidence(lang: str) -> Column:
    """The ordered evidence list of one row."""
    geo = F.col("geo")
    template = F.lit(None)
    for key in ("geo_inside", "geo_edge", "geo_just_outside", "geo_near_point", "geo_point", "geo_away"):
        template = F.when(geo["key"] == key, label(key, lang)).otherwise(template)
    where = F.replace(template, F.lit("{d}"), format_distance(geo["meters"], lang))
    point = F.when(geo["key"] == "no_geo", item("missing", label("no_geo", lang), geo["weight"])).otherwise(
        item("geo", where, geo["weight"]))
    building, named = F.col("building"), F.col("building.name")
    kind = building_type_name(building["type"], lang)
    unnamed = label("unnamed_building", lang)
    in_category = F.coalesce(F.col("matched_category") != "", F.lit(False))
    vision = F.lit(None)
    for verdict in ("veto", "inconclusive", "not_campus_place", "campus_place"):
        given = F.col("vision_veto") if verdict == "veto" else F.col("vision_label") == verdict
        words = F.when(F.col("vision_source") == "review", label(f"review_{verdict}", lang)).otherwise(
            label(f"vision_{verdict}", lang))
        vision = F.coalesce(vision, F.when(given, words))
    other = F.col("institution")
    content = (
        F.when(other.isNotNull(), item("content", label("other_institution", lang, m=other), INSTITUTION_WEIGHT))
        .when(F.col("people"), item("content", label("people", lang), PEOPLE_WEIGHT))
        .when(F.col("specimen"), item("content", label("specimen", lang), SPECIMEN_WEIGHT))
        .when(F.col("food"), item("content", label("food_closeup", lang), SPECIMEN_WEIGHT))
    )
    dated = dates.date_label(
        F.col("date_taken"), F.col("date_uploaded"), F.col("shown_date_source"), F.lit(lang))
    return F.array_compact(F.array(
        point,
        F.when(F.coalesce(building["inside_campus"], F.lit(False)), item("category", label(
            "building", lang, b=F.coalesce(F.nullif(named, F.lit("")), unnamed), t=kind), BUILDING_WEIGHT)),
        F.when((F.col("subject_kind") == "building") & (F.col("subject_name") != ""), item(
            "category", label("building_subject", lang, b=F.col("subject_name")), BUILDING_WEIGHT)),
        F.when(in_category & F.col("matched_subcategory"), item(
            "category", label("subcategory", lang, c=F.col("matched_category")), SUBCATEGORY_WEIGHT))
        .when(in_category, item("category", label("category", lang, c=F.col("matched_category")), CATEGORY_WEIGHT)),
        F.when(F.col("mention").isNotNull(), item("text", label("name", lang, n=F.col("mention")), NAME_WEIGHT)),
        F.when(F.col("official").isNotNull(), item("text", label("official", lang, s=F.col("official")), OFFICIAL_WEIGHT)),
        F.when(F.col("vision_checked") & (F.col("vision_label") != ""), item("vision", vision, F.col("vision_weight"))),
        content,
        F.when((F.coalesce(F.col("license"), F.lit("")) == "") & F.col("official").isNull(), item(
            "missing", label("no_license", lang), NO_LICENSE_WEIGHT)),
        F.when(dated.isNotNull(), item("date", dated, 0)),
        F.when(~F.col("vision_checked"), item("missing", label("not_visually_checked", lang), 0))))


def confidence_of(evidence: Column) -> Column:
    """Clamped sum; at most 59 without positive place evidence, or with any sign of something else."""
    total = F.aggregate(evidence, F.lit(BASE_CONFIDENCE), lambda s, e: s + e["weight"])
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), total))
    placed = F.exists(evidence, lambda e: e["type"].isin(PLACE_TYPES) & (e["weight"] > 0))
    other = F.exists(evidence, lambda e: e["type"] == "content")
    return F.when(placed & ~other, clamped).otherwise(F.least(clamped, F.lit(UNCONFIRMED_MAX)))


def tier_of(confidence: Column) -> Column:
    return F.when(confidence >= VERIFIED_FROM, "verified").when(confidence >= LIKELY_FROM, "likely").otherwise("unconfirmed")


def apply_caps(confidence: Column, veto: Column, checked: Column) -> Column:
    """A veto never rises above unconfirmed; an unchecked row never reaches verified."""
    return F.when(veto, F.least(confidence, F.lit(UNCONFIRMED_MAX))).when(
        ~checked & (confidence >= VERIFIED_FROM), VERIFIED_FROM - 1).otherwise(confidence)


def is_highlight() -> Column:
    shown = F.col("vision_highlight") | F.col("showcase")
    return (F.col("category") == "campus") & (F.col("tier") != "unconfirmed") & shown


def text_marks(images: DataFrame, campus: DataFrame) -> DataFrame:
    """What the texts of images say, as narrow columns in place of the texts; rows that are no photo of a place are gone."""
    names = campus.select("profile_id", F.col("names").alias("own_names"), text.prepare_names(F.col("names")).alias("own_prepared"), "official_domains")
    read = places(images).join(names, "profile_id", "left").withColumn(
        "_folded", text.folded_if_named(own_text(), F.col("_own"), F.col("own_prepared"))).withColumn("_norm", text.normalized_if_named(F.col("_folded"), F.col("own_prepared")))
    marked = read.withColumns({
        "people": people_or_event(), "specimen": specimen(), "food": food_closeup(), "institution": other_institution(
            F.col("own_names"), rules.matches("_own", rules.OTHER_INSTITUTION, "_own_signs")),
        "mention": text.mentioned_name(own_text(), F.col("own_prepared"), F.col("_norm")), "official": official_domain(F.col("official_domains")),
        "text_category": text_category(), "showcase": rules.matches("_own", rules.SHOWCASE, "_own_signs")})
    return marked.withColumn("text_tags", text_tags()).drop(
        "description", "source_categories", "own_names", "own_prepared", "official_domains", "_own", "_all", "_title", "_desc",
        "_own_signs", "_all_signs", "_folded", "_norm")


def score(
    images: DataFrame, campus: DataFrame, buildings: DataFrame | None = None, lang: str = "en"
) -> DataFrame:
    """Image rows to photo rows. Rows that are no photo of a place are removed before any other work.

    `campus` has profile_id, names[], lat, lng, ring and official_domains[]. Every expression stays in the JVM. Texts are read
    once, where they lie: a profile's names come to them (Spark broadcasts them if they are small enough), and what goes on to
    the joins with outlines and buildings are flags and short fields.
    """
    marked = text_marks(images, campus)
    context = spatial.with_outline(campus).select("profile_id", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"), "edges", "ring_center")
    joined = marked.join(context, "profile_id", "left")
    if buildings is None:
        joined = joined.withColumn("building", F.lit(None).cast(
            "struct<ord:bigint,building_id:string,name:string,type:string,inside_campus:boolean>"))
    else:
        hits = spatial.building_at(images.select("profile_id", "seq", "lat", "lng"), buildings)
        joined = joined.join(hits, ["profile_id", "seq"], "left")
    flagged = joined.withColumns({
        "geo": spatial.position(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"), F.col("edges"),
                                F.col("ring_center")),
        "shown_date_source": dates.date_source(
            F.col("date_taken"), F.col("date_uploaded"), F.col("date_source"), F.col("date_hint_year")),
    })
    linked = F.coalesce(F.col("matched_category") != "", F.lit(False)) | F.col("mention").isNotNull() | F.col(
        "official").isNotNull()
    flagged = flagged.withColumn("linked", linked).withColumn(
        "off_campus", (F.col("geo.on_campus") == F.lit(False)) | (
            F.col("geo.on_campus").isNull() & F.col("lat").isNotNull() & ~F.col("linked"))).withColumn(
        "off_campus", F.coalesce("off_campus", F.lit(False)))
    category, tags = classify()
    scored = flagged.withColumn("evidence", build_evidence(lang)).withColumn(
        "confidence", apply_caps(confidence_of(F.col("evidence")), F.col("vision_veto"), F.col("vision_checked"))
    ).withColumns({"tier": tier_of(F.col("confidence")), "category": category, "tags": tags}).withColumns({
        "highlight": is_highlight(),
        "freshness": dates.freshness(F.col("date_taken"), F.col("date_hint_year")),
        "author": F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown")),
        "license": F.coalesce(F.nullif("license", F.lit("")), F.lit("unknown")),
        "date_source": F.col("shown_date_source")})
    return scored.select(
        "profile_id", "seq", "id", "source", "thumb_url", "full_url", "title", "sha1", "category", "tags", "confidence", "tier",
        "source_url", "source_domain", "author", "license", "date_taken", "date_uploaded", "date_source", "freshness",
        "vision_checked", "vision_label", "vision_veto", "highlight", "lat", "lng", "heading_deg", "evidence",
        F.col("building.building_id").alias("building_id"))
