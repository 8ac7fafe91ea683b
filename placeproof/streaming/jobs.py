"""The pipeline as incremental jobs: append-only inputs and batch tables on shared storage.

A batch table keeps one folder per micro-batch. A batch that runs again after a failure replaces its own folder and reads
only the others, so every job gives each change exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeproof.operators import dedupe, evidence, events, verdicts
from placeproof.operators.skew import previous_row
from placeproof.operators.spend import with_cost
from placeproof.session import cut_lineage

CHANGE_BLOCK_ROWS = 1 << 16


def follow(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """An append-only log: a new reader sees everything so far and then what arrives, as often as it likes."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what is there in micro-batches and stop; the checkpoint lets the next run go on from there."""
    running = stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    running.awaitTermination()
    return running


class BatchTable:
    """Rows of a job in a folder for each batch. `version` grows with every new batch and says which rows are later; a batch that
    runs again replaces its own folder and is compared with the others only."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema + ", version bigint"
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{path}/batch=none")

    def rows(self, but: str | int | None = None) -> DataFrame:
        """All rows with their `version` and `batch`, or those of the other batches."""
        stored = self.spark.read.schema(self.schema + ", batch string").parquet(self.path)
        return stored if but is None else stored.filter(F.col("batch") != str(but))

    def write(self, rows: DataFrame, batch: str | int) -> None:
        version = self.rows(batch).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        rows.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def latest(self, keys: list[str], but: str | int | None = None, order: list[str] | None = None) -> DataFrame:
        """The last row of each key, by `order` (a number that the input carries) and then by version."""
        stamped = self.rows(but).withColumn("_at", F.struct(*(order or []), "version"))
        return events.keep_last(stamped, keys, "_at").drop("_at", "version", "batch")


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


# ---- changes by key ----


class Changes:
    """Rows whose content differs from that of the row before them in the order of `seq`; repeats are ignored.

    Rows may come in any order and batch: one that comes late is judged in its place, and what follows it once more, so `current`
    is always what one batch over all rows so far gives. With `expires` (a time column and seconds) a key is forgotten after
    that long, so a later repeat counts as new. A key and number that came before is a repeated delivery and changes nothing.

    Rows are kept in blocks of `seq`. A batch reads the blocks it touches, the stored blocks next to them, and a table of which
    blocks a key has; a hot key costs as many blocks as its new rows fall into, and its blocks are judged in different tasks.
    """

    def __init__(
        self, spark: SparkSession, root: str, schema: str, key: str, content: list[str], expires: tuple[str, int] | None = None,
        block_rows: int = CHANGE_BLOCK_ROWS,
    ) -> None:
        empty = spark.createDataFrame([], schema)
        self.key, self.content, self.expires, self.block_rows, self.fields = key, content, expires, block_rows, empty.columns
        self.seen = BatchTable(spark, f"{root}/seen", f"{schema}, _hash bigint, _micros bigint, _change boolean")
        self.blocks = BatchTable(spark, f"{root}/blocks", f"`{key}` {dict(empty.dtypes)[key]}, _block bigint")

    def _reached(self, touched: DataFrame, batch: int) -> DataFrame:
        """(key, _block, _judged): the touched blocks and the block after each are judged; the one before is only read."""
        known = self.blocks.rows(batch).select(self.key, "_block").join(touched.select(self.key).distinct(), self.key, "left_semi")
        every = known.withColumn("_new", F.lit(False)).unionByName(touched.withColumn("_new", F.lit(True))).groupBy(
            self.key, "_block").agg(F.max("_new").alias("_new"))
        order = Window.partitionBy(self.key).orderBy("_block")
        return every.withColumns({
            "_judged": F.col("_new") | F.lag("_new", 1, False).over(order), "_read": F.lead("_new", 1, False).over(order)}).filter(
            "_judged OR _read").select(self.key, "_block", "_judged")

    def add(self, rows: DataFrame, batch: int) -> None:
        place, block = [self.key, "seq"], F.floor(F.col("seq") / F.lit(self.block_rows)).cast("bigint")
        micros = F.unix_micros(self.expires[0]) if self.expires else F.lit(None).cast("bigint")
        fresh = cut_lineage(rows.select(*self.fields).dropDuplicates(place).withColumns({
            "_hash": F.xxhash64(F.to_json(F.struct(*self.content))), "_micros": micros, "_change": F.lit(None).cast("boolean"),
            "_block": block}))
        touched = fresh.select(self.key, "_block").distinct()
        stored = self.seen.rows(batch).withColumn("_block", block).join(self._reached(touched, batch), [self.key, "_block"])
        known = cut_lineage(events.keep_last(stored, place, "version").drop("version", "batch"))
        pool = cut_lineage(known.unionByName(fresh.withColumn("_judged", F.lit(True)).join(known, place, "left_anti")))
        linked = previous_row(pool, [self.key], "seq", {"_before": "_hash", "_then": "_micros"}, self.block_rows)
        gone = F.coalesce(F.col("_micros") - F.col("_then") > self.expires[1] * 1_000_000, F.lit(False)) if self.expires else F.lit(False)
        now = F.col("_before").isNull() | (F.col("_before") != F.col("_hash")) | gone
        judged = linked.filter("_judged").withColumn("_now", now).filter("_change IS NULL OR _change <> _now")
        self.seen.write(judged.select(*self.fields, "_hash", "_micros", F.col("_now").alias("_change")), batch)
        self.blocks.write(touched, batch)

    def current(self) -> DataFrame:
        """The changes as of now."""
        return events.keep_last(self.seen.rows(), [self.key, "seq"], "version").filter("_change").select(*self.fields)


def fold_stream(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last payload per key, updated as events arrive."""
    return stream.groupBy(*keys).agg(F.max(F.struct("seq", "payload")).alias("last")).select(*keys, "last.seq", "last.payload")


class DailyBudget:
    """Spend per UTC day: every batch stores its sums, and the day's total is theirs, however late a call arrives."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spent = BatchTable(spark, root, "day date, user_id bigint, spent bigint")

    def add(self, rows: DataFrame, batch: int, time: str = "ts") -> None:
        dated = with_cost(rows).withColumn("day", F.to_date(time))
        self.spent.write(dated.groupBy("day", "user_id").agg(F.sum("cost").cast("bigint").alias("spent")), batch)

    def by_user(self) -> DataFrame:
        return self.spent.rows().groupBy("day", "user_id").agg(F.sum("spent").alias("spent"))

    def total(self) -> DataFrame:
        return self.spent.rows().groupBy("day").agg(F.sum("spent").alias("spent"), F.count_distinct("user_id").alias("users"))


# ---- the profile build ----


class ProfileBuild:
    """Images, outlines and verdicts arrive in any order; photos come out again under their id only when they change.

    Each input has a table of its own, and they meet when photos are published: an image has its version with the largest
    `seq`, its last verdict, if there is one yet, and its profile's last outline. So repeats change nothing, a verdict may
    come before its image, and a new version of an image keeps the verdict.
    """

    KEYS = ["profile_id", "id"]

    def __init__(self, spark: SparkSession, root: str, images: str, campus: str, buildings: DataFrame | None = None) -> None:
        verdict = schema_text(spark.range(0).select(verdicts.review_verdict(F.lit("{}")).alias("verdict")))
        self.images = BatchTable(spark, f"{root}/images", images)
        self.campus = BatchTable(spark, f"{root}/campus", campus)
        self.verdicts = BatchTable(spark, f"{root}/verdicts", f"profile_id bigint, id string, seq bigint, {verdict}")
        probe = evidence.score(
            spark.createDataFrame([], images), spark.createDataFrame([], campus), buildings).drop("title")
        self.fields = probe.columns
        self.photos = BatchTable(spark, f"{root}/photos", schema_text(probe) + ", removed boolean")
        self.buildings = buildings

    def _publish(self, touched: DataFrame, batch: str) -> None:
        """Score the touched images as all inputs now say and append what differs from the last published version."""
        images = self.images.latest(self.KEYS, order=["seq"]).join(touched.distinct(), self.KEYS, "left_semi")
        answers = self.verdicts.latest(self.KEYS, order=["seq"]).select(*self.KEYS, "verdict")
        told = verdicts.apply_verdict(images.join(answers, self.KEYS, "left")).select(images.columns)
        now = cut_lineage(evidence.score(told, self.campus.latest(["profile_id"]), self.buildings).select(self.fields))
        gone = images.select(*self.KEYS).join(now, self.KEYS, "left_anti")
        stamped = now.withColumns({"removed": F.lit(False), "stamp": F.xxhash64(F.to_json(F.struct(*self.fields)))})
        seen = self.photos.latest(self.KEYS, batch).select(*self.KEYS, F.col("removed").alias("was_removed"), F.xxhash64(
            F.to_json(F.struct(*self.fields))).alias("old"))
        changed = stamped.join(seen, self.KEYS, "left").filter(
            F.col("old").isNull() | F.col("was_removed") | (F.col("old") != F.col("stamp"))).select(*self.fields, "removed")
        withdrawn = seen.filter(~F.col("was_removed")).join(gone, self.KEYS, "left_semi").select(
            *[F.col(c) if c in self.KEYS else F.lit(None).alias(c) for c in self.fields], F.lit(True).alias("removed"))
        self.photos.write(changed.unionByName(withdrawn), batch)

    def add_images(self, rows: DataFrame, batch: int) -> None:
        """New or changed images."""
        self.images.write(events.keep_last(rows, self.KEYS, "seq"), f"images-{batch}")
        self._publish(rows.select(*self.KEYS), f"images-{batch}")

    def add_campus(self, rows: DataFrame, batch: int) -> None:
        """Outlines: all images of the touched profiles are scored again. Of several for a profile in a batch one is taken."""
        self.campus.write(rows.dropDuplicates(["profile_id"]), f"campus-{batch}")
        self._publish(self.images.rows().join(rows.select("profile_id"), "profile_id", "left_semi").select(*self.KEYS), f"campus-{batch}")

    def add_verdicts(self, rows: DataFrame, batch: int) -> None:
        """Visual verdicts (profile_id, id, verdict and, if known, seq); the last of an image holds, now or when the image comes."""
        numbered = rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0).cast("bigint"))
        self.verdicts.write(events.keep_last(numbered.select(*self.KEYS, "seq", "verdict"), self.KEYS, "seq"), f"verdicts-{batch}")
        self._publish(rows.select(*self.KEYS), f"verdicts-{batch}")

    def current(self) -> DataFrame:
        return self.photos.latest(self.KEYS).filter(~F.col("removed")).drop("removed")


class DuplicateStream:
    """Groups of arriving photos, which may come in any order.

    Photos that come after all stored ones of their profile are placed by an index: the least group of each exact key and signature.
    Stored photos are not grouped again then, because matches only look at earlier rows. Profiles in which a photo comes late, or a
    stored photo gets its signature, are grouped anew. More photos and keys can only lower a group, so the least one written
    for a photo or a key holds. A photo that comes again is passed over.
    """

    PHOTO = "profile_id bigint, seq bigint, source string, title string, sha1 string, sig bigint"
    PLACE = ["profile_id", "seq"]

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.photos = BatchTable(spark, f"{root}/photos", self.PHOTO)
        self.groups = BatchTable(spark, f"{root}/groups", "profile_id bigint, seq bigint, group_seq bigint")
        self.index = BatchTable(spark, f"{root}/index", "profile_id bigint, class string, group_seq bigint")
        self.fields = spark.createDataFrame([], self.PHOTO).columns

    def _write(self, photos: DataFrame, grouped: DataFrame, groups: DataFrame, name: str) -> None:
        settled = cut_lineage(groups)
        self.index.write(dedupe.class_index(grouped, settled), name)
        self.groups.write(settled, name)
        self.photos.write(photos, name)

    def _anew(self, profiles: DataFrame, instead: DataFrame, name: str) -> DataFrame:
        """All photos of these profiles, those of `instead` in place of stored ones."""
        stored = self.photos.latest(self.PLACE, name).join(instead.select(*self.PLACE), self.PLACE, "left_anti")
        return cut_lineage(stored.unionByName(instead).join(profiles, "profile_id", "left_semi"))

    def add(self, rows: DataFrame, batch: int) -> None:
        """New photos."""
        name = f"photos-{batch}"
        stored = self.photos.rows(name).select(*self.PLACE)
        fresh = cut_lineage(rows.select(*self.fields).dropDuplicates(self.PLACE).join(stored, self.PLACE, "left_anti"))
        first = fresh.groupBy("profile_id").agg(F.min("seq").alias("_first"))
        late = cut_lineage(stored.join(first, "profile_id").filter("seq > _first").select("profile_id").distinct())
        grouped = fresh.join(late, "profile_id", "left_anti")
        groups = dedupe.place_into_groups(grouped, self.index.rows(name))
        if not late.isEmpty():
            every = self._anew(late, fresh, name)
            grouped, groups = grouped.unionByName(every), groups.unionByName(dedupe.group_duplicates(every))
        self._write(fresh, grouped, groups, name)

    def add_signatures(self, rows: DataFrame, batch: int) -> None:
        """Signatures (profile_id, seq, sig) of stored photos that had none; others are passed over."""
        name = f"signatures-{batch}"
        given = rows.filter(F.col("sig").isNotNull()).groupBy(*self.PLACE).agg(F.min("sig").alias("_sig"))
        signed = cut_lineage(self.photos.latest(self.PLACE, name).filter(F.col("sig").isNull()).join(given, self.PLACE).withColumn(
            "sig", F.col("_sig")).select(*self.fields))
        every = self._anew(signed.select("profile_id").distinct(), signed, name)
        self._write(signed, every, dedupe.group_duplicates(every), name)

    def current(self) -> DataFrame:
        """(profile_id, seq, group_seq) as of now."""
        return self.groups.rows().groupBy(*self.PLACE).agg(F.min("group_seq").alias("group_seq"))
