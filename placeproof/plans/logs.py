"""Registered queries on event logs, spend, conversations and plain set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeproof.operators import events, ranking, reports, spend
from placeproof.plans import views
from placeproof.plans.registry import query
from placeproof.sources.images import filter_min_side, union_sources
from placeproof.sources.maps import filter_subcategories

USER_CAP, DAY_CAP = 3_000_000, 20_000_000
COST = "input_tokens * CASE model WHEN 'small' THEN 1 WHEN 'medium' THEN 2 ELSE 5 END + output_tokens * CASE model WHEN 'small' THEN 5 WHEN " \
       "'medium' THEN 10 ELSE 25 END + web_searches * 10000"
COSTED = f"WITH {views.with_views('usage')}, c AS (SELECT *, {COST} AS cost FROM usage)"


@query("user_usage", f"{COSTED} SELECT CAST(day AS VARCHAR) AS day, user_id, CAST(sum(cost) AS BIGINT) AS spent, CAST(greatest(0, {USER_CAP} - "
                     "sum(cost)) AS BIGINT) AS remaining FROM c GROUP BY ALL")
def user_usage(spark, sf_dir):
    return spend.user_usage(views.usage(spark, sf_dir), USER_CAP).withColumn("day", F.col("day").cast("string"))


@query("daily_usage", f"{COSTED} SELECT CAST(day AS VARCHAR) AS day, CAST(sum(cost) AS BIGINT) AS total, count(*) AS calls, "
                      "CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, "
                      "count(DISTINCT user_id) AS users FROM c GROUP BY ALL")
def daily_usage(spark, sf_dir):
    return spend.daily_usage(views.usage(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("spend_admission", f"{COSTED}, u AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY day, user_id ORDER BY seq ROWS BETWEEN UNBOUNDED "
       f"PRECEDING AND 1 PRECEDING), 0) < {USER_CAP // 50} AS ok FROM c), d AS (SELECT *, coalesce(sum(CASE WHEN ok THEN cost ELSE 0 END) OVER "
       f"(PARTITION BY day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {DAY_CAP // 4} AS open FROM u) "
       "SELECT seq, ok AND open AS admitted FROM d")
def spend_admission(spark, sf_dir):
    return spend.spend_admission(views.usage(spark, sf_dir), USER_CAP // 50, DAY_CAP // 4).select("seq", "admitted")


# ---- event log ----

@query("fold_events", """SELECT user_id, event_type, arg_max(props, event_id) AS payload, max(event_id) AS seq FROM events GROUP BY ALL""")
def fold_events(spark, sf_dir):
    log = views.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    return events.fold_events(log, ["user_id", "event_type"]).select("user_id", "event_type", "payload", "seq")


def _log(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")


@query("keep_first", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(props, event_id) AS props FROM events GROUP BY ALL")
def keep_first(spark, sf_dir):
    return events.keep_first(_log(spark, sf_dir), ["user_id", "event_type"], "event_id")


@query("keep_last", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY ALL")
def keep_last(spark, sf_dir):
    return events.keep_last(_log(spark, sf_dir), ["user_id", "event_type"], "event_id")


@query("version_changed", """SELECT event_id FROM (SELECT *, lag(props) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS before, lag(event_type)
    OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS type_before FROM (SELECT event_id, user_id, left(event_type, 1) AS event_type,
    CAST(event_id % 2 AS VARCHAR) AS props FROM events)) WHERE before IS NULL OR before <> props OR type_before <> event_type""")
def version_changed(spark, sf_dir):
    log = _log(spark, sf_dir).select("event_id", (F.col("user_id") % 3).alias("id"), F.left("event_type", F.lit(1)).alias("kind"),
                                     (F.col("event_id") % 2).cast("string").alias("props"))
    return events.version_changed(log, ["id"], ["kind", "props"], "event_id").select("event_id")


@query("keep_final", f"WITH {views.with_views('img')} " + """SELECT i.id, i.profile_id, o_orderkey AS place FROM orders o JOIN img i ON i.id =
    'img-' || (o_orderkey * 3) AND i.profile_id = (o_orderkey * 3) % 25""")
def keep_final(spark, sf_dir):
    final = views.table(spark, sf_dir, "orders").selectExpr(
        "(o_orderkey * 3) % 25 AS profile_id", "'img-' || (o_orderkey * 3) AS id", "o_orderkey AS place")
    return events.keep_final(views.images(spark, sf_dir).select("profile_id", "id"), final)


@query("pending_work", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_work(spark, sf_dir):
    return events.pending_work(views.table(spark, sf_dir, "documents").select("doc_id"), views.table(spark, sf_dir, "labels"), ["doc_id"])


FOUND = {"profile_id": "event_id % 7", "id": "user_id", "origin": views.case("(event_id * 7 + user_id) % 5", ["nearby", "subcategory", "nearby", "nearby"],
                                                                          "'category'"),
         "category": "CASE WHEN (event_id * 7 + user_id) % 5 IN (1, 4) THEN event_type END", "seq": "event_id"}


@query("provenance", f"WITH f AS ({views.select_sql('events', FOUND)}), r AS (SELECT *, row_number() OVER (PARTITION BY profile_id, id ORDER BY CASE "
       "origin WHEN 'category' THEN 0 WHEN 'subcategory' THEN 1 ELSE 2 END, seq) AS n, bool_or(origin = 'nearby') OVER (PARTITION BY profile_id, "
       "id) AS found_nearby FROM f) SELECT profile_id, id, category AS matched_category, origin = 'subcategory' AS matched_subcategory, "
       "found_nearby FROM r WHERE n = 1")
def provenance(spark, sf_dir):
    return events.provenance(views.derived(spark, sf_dir, "events", FOUND))


@query("recent_history", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM (SELECT conv_id, turn,
    CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'assistant' ELSE role END AS role, text FROM conversations)), k AS (SELECT *, max(CASE WHEN role
    = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS started FROM t WHERE n <= 10 AND trim(text) <> '') SELECT conv_id,
    turn, role FROM k WHERE started = 1""")
def recent_history(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").withColumn("role", F.when(
        (F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), "assistant").otherwise(F.col("role")))
    return events.recent_history(turns, ["conv_id"]).select("conv_id", "turn", "role")


@query("pick_language_version", """SELECT source, lang, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE
    lang WHEN 'es' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, doc_id) AS n FROM documents WHERE trim(text) <> '') WHERE n = 1""")
def pick_language_version(spark, sf_dir):
    texts = views.table(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").alias("seq"), "text")
    return events.pick_language_version(texts, ["source"], "es").select("source", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("alive_entries", """SELECT event_id FROM events WHERE epoch_us(ts) + 1000000::BIGINT * CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0
    THEN 300 ELSE 1800 END WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 300 ELSE 21600 END WHEN 'signup' THEN 21600 WHEN 'error' THEN
    3600 ELSE 604800 END > epoch_us(TIMESTAMP '2024-01-20 00:00:00')""")
def alive_entries(spark, sf_dir):
    kind = F.expr("CASE event_type WHEN 'click' THEN 'profile' WHEN 'view' THEN 'shape' WHEN 'signup' THEN 'source' WHEN 'error' THEN "
                  "'street_level_source' ELSE 'verdict' END")
    entries = views.table(spark, sf_dir, "events").select(
        "event_id", kind.alias("kind"), F.col("ts").cast("timestamp").alias("stored_at"), (F.col("event_id") % 2 == 0).alias("partial"))
    return events.alive(entries, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


STATUS = f"WITH {views.with_views('status')}"


@query("is_partial", f"{STATUS} SELECT profile_id, bool_or((status IN ('timeout', 'error') AND profile_id % 2 = 0) OR elapsed_s > 48.5e0) AS partial "
                     "FROM status GROUP BY profile_id")
def is_partial(spark, sf_dir):
    rows = views.status(spark, sf_dir).withColumns({
        "deadline_hit": F.col("elapsed_s") > 48.5, "detail": F.lit(None).cast("string"),
        "status": F.when(F.col("profile_id") % 2 == 0, F.col("status")).otherwise("ok")})
    return reports.is_partial(rows)


@query("searched_sources", f"{STATUS} SELECT DISTINCT profile_id, source FROM status WHERE status IN ('ok', 'timeout')")
def searched_sources(spark, sf_dir):
    return reports.searched_sources(views.status(spark, sf_dir)).select("profile_id", "source").distinct()


@query("deadline_cutoff", f"{STATUS} SELECT seq FROM status WHERE elapsed_s <= 29e0")
def deadline_cutoff(spark, sf_dir):
    return events.deadline_cutoff(views.status(spark, sf_dir))[0].select("seq")


@query("deadline_profiles", f"{STATUS} SELECT profile_id, bool_or(elapsed_s > 29e0) AS deadline_hit FROM status GROUP BY profile_id")
def deadline_profiles(spark, sf_dir):
    return events.deadline_cutoff(views.status(spark, sf_dir))[1]


@query("source_state", f"{STATUS} SELECT profile_id, source, count_if(elapsed_s <= 7.5e0) AS count, CASE WHEN count_if(elapsed_s <= 7.5e0) > 0 THEN "
                       "'ok' ELSE 'timeout' END AS status FROM status GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY profile_id, source"))
def source_state(spark, sf_dir):
    return events.source_state(views.status(spark, sf_dir)).select("profile_id", "source", "count", "status")


@query("recent_then_backfill", """WITH e AS (SELECT event_id, user_id, ts >= TIMESTAMP '2024-01-28' AS recent FROM events), n AS (SELECT user_id,
    count_if(recent) AS k FROM e GROUP BY user_id) SELECT event_id FROM e JOIN n USING (user_id) WHERE recent OR k < 5""")
def recent_then_backfill(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    recent = F.col("ts") >= F.lit("2024-01-28").cast("timestamp")
    return ranking.recent_then_backfill(rows, ["user_id"], recent, 5).select("event_id")


@query("recent_first_cap", """SELECT event_id, position FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS
    position FROM events) WHERE position <= 120""")
def recent_first_cap(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return ranking.top_per_key(rows, ["event_type"], [F.desc("ts"), F.col("event_id")], 120).select("event_id", "position")


# ---- filters and sets ----

@query("filter_min_side", f"WITH {views.with_views('img')} SELECT id FROM img WHERE width IS NULL OR height IS NULL OR least(width, height) >= 200")
def min_side(spark, sf_dir):
    return filter_min_side(views.images(spark, sf_dir).select("id", "width", "height")).select("id")


SUBS = {"profile_id": "s_nationkey", "name": "CASE s_suppkey % 5 WHEN 0 THEN 'Portraits ' || s_name WHEN 1 THEN s_name || ' in 2025' WHEN 2 THEN "
        "s_name || ' in 2019' WHEN 3 THEN 'Maps of ' || s_name ELSE s_name END"}


@query("filter_subcategories", f"WITH s AS ({views.select_sql('supplier', SUBS)}) SELECT profile_id, name, position FROM (SELECT *, row_number() "
       "OVER (PARTITION BY profile_id ORDER BY CASE WHEN contains(name, '2025') THEN 0 ELSE 1 END, lower(name), name) AS position FROM s WHERE "
       "NOT contains(name, 'Portrait') AND NOT contains(name, 'Maps')) WHERE position <= 12")
def subcategories(spark, sf_dir):
    return filter_subcategories(views.derived(spark, sf_dir, "supplier", SUBS)).select("profile_id", "name", "position")


@query("union_sources", f"WITH {views.with_views('img')} SELECT source, count(*) AS rows, count(lat) AS located, count_if(license IS NULL) AS "
                        "unlicensed FROM img GROUP BY source")
def union_all(spark, sf_dir):
    rows = views.images(spark, sf_dir)
    one = rows.filter("source = 'mapillary'").drop("sha1")
    two = rows.filter("source <> 'mapillary'").select(*reversed(rows.columns))
    return union_sources(one, two).groupBy("source").agg(
        F.count("*").alias("rows"), F.count("lat").alias("located"), F.count_if(F.col("license").isNull()).alias("unlicensed"))


@query("ordered_distinct", """SELECT p_partkey, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || '|' || p_brand END AS names FROM part""")
def ordered_distinct(spark, sf_dir):
    names = F.array_distinct(F.concat(F.array("p_type", "p_brand"), F.array("p_type", "p_brand")))
    return views.table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, "|").alias("names"))


@query("ids_intersect", "SELECT p_partkey, p_size % 5 = p_partkey % 5 OR p_size % 7 = p_partkey % 5 AS overlap FROM part")
def ids_intersect(spark, sf_dir):
    left, right = F.array(F.col("p_size") % 5, F.col("p_size") % 7), F.array((F.col("p_partkey") % 5).cast("int"))
    return views.table(spark, sf_dir, "part").select("p_partkey", F.arrays_overlap(left, right).alias("overlap"))


@query("parse_targets", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'campus=' || p_size || ',dorms=6' ELSE 'dorms=6' END AS targets
    FROM part""")
def parse_targets(spark, sf_dir):
    text = F.concat(F.lit(" campus = "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("x"),
                    F.lit(", dorms=6,bad,city=x"))
    entries = F.transform(F.array_sort(F.map_entries(ranking.parse_targets(text))), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return views.table(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, ",").alias("targets"))


@query("general_queries", """SELECT n_nationkey AS profile_id, left('"' || n_name || '" ' || topic || ' site:u' || n_nationkey || '.example.org',
    400) AS query FROM nation, (VALUES ('campus building 2024 2025'), ('library campus 2024 2025'), ('student housing dormitory 2024 2025'),
    ('laboratory campus 2024 2025'), ('sports center campus 2024 2025'), ('student life campus 2024 2025')) t(topic)""")
def general_queries(spark, sf_dir):
    profiles = views.table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS profile_id", "n_name AS name", "'https://www.u' || n_nationkey || '.example.org/en' AS website")
    return reports.general_queries(profiles)
