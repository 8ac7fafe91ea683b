"""Registered queries on signatures, verdicts and diversity, over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeproof.operators import dedupe, ranking, verdicts
from placeproof.plans import views
from placeproof.plans.registry import query

# Every vector gets a copy whose signature differs in 0, 1, 6 or 7 low bits.
FLIPS = [0, 1, 63, 127]
SIGNED = """s AS (SELECT vec_id, sum(CASE WHEN v > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0 END) AS sig FROM (SELECT vec_id, unnest(embedding) AS v,
    generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id), c AS (SELECT vec_id % 5 AS profile_id, vec_id * 2 AS seq, sig FROM s
    UNION ALL SELECT vec_id % 5, vec_id * 2 + 1, xor(sig, CASE vec_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 63 ELSE 127 END::HUGEINT) FROM s)"""


def signatures(vectors):
    signed = vectors.select("vec_id", dedupe.sign_signature(F.col("embedding")).alias("sig"))
    mask = F.expr(views.case("vec_id % 4", FLIPS)).cast("bigint")
    first = signed.select((F.col("vec_id") % 5).alias("profile_id"), (F.col("vec_id") * 2).alias("seq"), "sig")
    return first.unionByName(signed.select(
        (F.col("vec_id") % 5).alias("profile_id"), (F.col("vec_id") * 2 + 1).alias("seq"), F.col("sig").bitwiseXOR(mask).alias("sig")))


def _signatures(spark, sf_dir):
    return signatures(views.table(spark, sf_dir, "embeddings"))


@query("sign_signature", f"WITH {SIGNED} SELECT seq, CAST(bit_count(sig) AS INT) AS bits, CAST(sig % 1000003 AS BIGINT) AS digest FROM c")
def sign_signature(spark, sf_dir):
    unsigned = F.col("sig").cast("decimal(38,0)") + F.when(F.col("sig") < 0, F.lit("18446744073709551616").cast("decimal(38,0)")).otherwise(0)
    return _signatures(spark, sf_dir).select(
        "seq", F.bit_count("sig").alias("bits"), (unsigned % 1_000_003).cast("bigint").alias("digest"))


@query("near_signatures", f"WITH {SIGNED}, d AS (SELECT profile_id, sig, min(seq) AS seq FROM c GROUP BY ALL) SELECT a.profile_id, least(a.seq, "
                          "b.seq) AS first_seq, greatest(a.seq, b.seq) AS second_seq FROM d a JOIN d b ON a.profile_id = b.profile_id AND a.sig < "
                          "b.sig AND bit_count(xor(a.sig, b.sig)) <= 6".replace("GROUP BY ALL", "GROUP BY profile_id, sig"))
def near_signatures(spark, sf_dir):
    rows = _signatures(spark, sf_dir)
    first = rows.groupBy("profile_id", "sig").agg(F.min("seq").alias("seq"))
    pairs = dedupe.near_signatures(rows)
    a = first.select("profile_id", F.col("sig").alias("sig_a"), F.col("seq").alias("a"))
    b = first.select("profile_id", F.col("sig").alias("sig_b"), F.col("seq").alias("b"))
    return pairs.join(a, ["profile_id", "sig_a"]).join(b, ["profile_id", "sig_b"]).select(
        "profile_id", F.least("a", "b").alias("first_seq"), F.greatest("a", "b").alias("second_seq"))


@query("group_near_duplicates", f"WITH RECURSIVE {SIGNED}, link AS (SELECT a.seq AS x, b.seq AS y FROM c a JOIN c b ON a.profile_id = b.profile_id "
       "AND b.seq < a.seq AND bit_count(xor(a.sig, b.sig)) <= 6), reach(seq, y) AS (SELECT seq, seq FROM c UNION SELECT r.seq, l.y FROM reach r "
       "JOIN link l ON l.x = r.y) SELECT seq, min(y) AS group_seq FROM reach GROUP BY seq")
def group_near_duplicates(spark, sf_dir):
    rows = _signatures(spark, sf_dir).withColumns({
        "source": F.lit("a"), "title": F.lit(""), "sha1": F.lit(None).cast("string")})
    return dedupe.group_duplicates(rows).select("seq", "group_seq")


@query("phash64")
def phash64(spark, sf_dir):
    pixels = F.transform("embedding", lambda v: v.cast("double"))
    return views.table(spark, sf_dir, "embeddings").select("vec_id", dedupe.phash64(pixels).alias("hash"))


def _verdict_columns(verdict):
    return [verdict["label"].alias("label"), verdict["weight"].cast("int").alias("weight"), verdict["veto"].alias("veto"),
            verdict["category"].alias("category")]


def _prompts(spark, sf_dir):
    """The first nine vectors stand for the prompts: a fixed number of constants, read once as a scalar."""
    rows = views.table(spark, sf_dir, "embeddings").filter("vec_id < 9")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda p: p["embedding"]).alias("prompts")).scalar()


def _similarities():
    return F.transform("prompts", lambda p: verdicts.dot(F.col("embedding"), p))


@query("prompt_verdict", """WITH sim AS (SELECT e.vec_id, p.vec_id AS k, list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS s FROM
    embeddings e, embeddings p WHERE p.vec_id < 9), m AS (SELECT vec_id, max(s) FILTER (k < 4) AS good, arg_max(k, s) FILTER (k < 4) AS best, max(s)
    FILTER (k >= 4) AS bad FROM sim GROUP BY vec_id) SELECT vec_id, CASE WHEN good - bad <= -0.03e0 THEN 'not_campus_place' WHEN good - bad >=
    0.03e0 THEN 'campus_place' ELSE 'inconclusive' END AS label, CASE WHEN good - bad <= -0.03e0 THEN -20 WHEN good - bad >= 0.03e0 THEN 12 ELSE 0
    END AS weight, good - bad <= -0.07e0 AS veto, CASE WHEN good - bad >= 0.03e0 THEN CASE best WHEN 1 THEN 'libraries' WHEN 2 THEN 'classrooms'
    WHEN 3 THEN 'dorms' END END AS category FROM m""")
def prompt_verdict(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings").withColumn("prompts", _prompts(spark, sf_dir))
    return rows.withColumn("v", verdicts.prompt_verdict(_similarities())).select("vec_id", *_verdict_columns(F.col("v")))


ANSWER = {
    "event_id": "event_id",
    "label": views.case("event_id % 6", ["campus_place", "building_interior", "people_or_event", "object_or_sample", "not_a_photo",
                                         "unrelated_place"]),
    "category": views.case("event_id % 4", ["campus", "dorms", "libraries", "city"]),
    "confidence": "event_id % 101", "highlight": "event_id % 3 = 0",
}


def _answers(spark, sf_dir):
    rows = views.derived(spark, sf_dir, "events", ANSWER)
    return rows.select("event_id", F.to_json(F.struct("label", "category", "confidence", "highlight")).alias("answer"))


REVIEWED = f"""a AS ({views.select_sql('events', ANSWER)}), v AS (SELECT event_id, CASE WHEN confidence < 70 THEN 'inconclusive' WHEN label IN
    ('campus_place', 'building_interior') THEN 'campus_place' ELSE 'not_campus_place' END AS label, CASE WHEN confidence < 70 THEN 0 WHEN label IN
    ('campus_place', 'building_interior') THEN 16 ELSE -20 END AS weight, label = 'not_a_photo' AND confidence >= 90 AS veto, CASE WHEN confidence
    >= 70 AND label IN ('campus_place', 'building_interior') AND category IN ('dorms', 'libraries') THEN category END AS category FROM a)"""


@query("review_verdict", f"WITH {REVIEWED} SELECT * FROM v")
def review_verdict(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("v", verdicts.review_verdict(F.col("answer")))
    return rows.select("event_id", *_verdict_columns(F.col("v")))


@query("merge_verdicts", f"WITH {REVIEWED} SELECT event_id, CASE WHEN event_id % 2 = 0 AND (event_id % 5 = 0 OR label = 'inconclusive') THEN 12 WHEN "
                         "event_id % 5 = 0 THEN NULL ELSE weight END AS weight FROM v")
def merge_verdicts(spark, sf_dir):
    local = F.struct(F.lit("campus_place").alias("label"), F.lit(12).alias("weight"), F.lit(False).alias("veto"),
                     F.lit(None).cast("string").alias("category"), F.lit(False).alias("highlight"), F.lit("prompts").alias("source"))
    rows = _answers(spark, sf_dir).select(
        "event_id", F.when(F.col("event_id") % 2 == 0, local).alias("local"),
        F.when(F.col("event_id") % 5 != 0, verdicts.review_verdict(F.col("answer"))).alias("review"))
    return rows.select("event_id", verdicts.merge_verdicts(F.col("local"), F.col("review"))["weight"].cast("int").alias("weight"))


@query("cached_verdicts", """WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), r AS (SELECT event_id, user_id, ts FROM
    events WHERE event_type <> 'click') SELECT r.event_id, max(v.event_id) AS verdict FROM r LEFT JOIN v ON v.user_id = r.user_id AND v.ts <= r.ts AND
    v.ts > r.ts - INTERVAL 7 DAYS GROUP BY r.event_id""")
def cached_verdicts(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("full_url"), F.col("ts").cast(
        "timestamp").alias("ts"))
    stored = rows.filter("event_type = 'click'").select("full_url", F.col("ts").alias("checked_at"), F.col("event_id").alias("verdict"))
    asked = rows.filter("event_type <> 'click'").select("event_id", "full_url", F.col("ts").alias("asked_at"))
    return verdicts.cached_verdicts(asked, stored).select("event_id", "verdict")


@query("diverse_top")
def diverse_top(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 5).alias("profile_id"), F.lit("campus").alias("category"), F.col("vec_id").alias("seq"), F.lit("likely").alias("tier"),
        (F.lit(60) + F.col("label") % 3 * 5).alias("confidence"), F.lit("older").alias("freshness"), "embedding")
    return ranking.diverse_top(rows, 6).select("profile_id", "seq", "pick")
