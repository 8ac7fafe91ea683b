"""WARC as a content-addressed archive: payload bytes once under their SHA-256, exact record headers apart, records by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.llm.common import shared_folder

# Fixed values of the format: the base-32 alphabet, the header lines and the profile of a revisit.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: every five hex digits are four of its digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[x for name, value in pairs for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))])


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0, date: str = DATE) -> None:
    """Write `payloads` (address, n_bytes, payload) and `records` (page_id, address, warc_header, http_header) below `folder`.

    Of the rows with equal payloads of at least `least_bytes`, those with the largest id are responses and the others revisit
    them; smaller payloads are all responses. A null body is empty, a null URL too. Rows that repeat the largest id are
    responses as well; rows with a null id are responses only if no equal payload has an id. An empty table gives empty files.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.encode(F.col(body_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("address", F.sha2("payload", 256))
    rows.groupBy("address").agg(F.first("payload").alias("payload")).select(
        "address", F.octet_length("payload").cast("long").alias("n_bytes"), "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")
    narrow = rows.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("digest"))
    heads = narrow.groupBy("address").agg(F.max("page_id").alias("head"))
    told = narrow.join(heads, "address").withColumn("own", F.col("page_id").eqNullSafe(F.col("head")) | (F.col("n") < least_bytes))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    told = told.withColumn("http", http)
    block = F.octet_length("http") + F.when(F.col("own"), F.col("n")).otherwise(0)
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _lines(("WARC-Type", F.when(F.col("own"), "response").otherwise("revisit")), ("WARC-Record-ID", name("page_id")), ("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", " ")), ("WARC-Date", F.lit(date)), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))),
        F.when(F.col("own"), "").otherwise(_lines(("WARC-Refers-To", name("head")), ("WARC-Profile", F.lit(REVISIT_PROFILE)))),
        _lines(("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", block.cast("string"))), F.lit("\r\n"))
    told.select("page_id", "address", F.encode(header, "UTF-8").alias("warc_header"), F.encode("http", "UTF-8").alias("http_header")).write.option(
        "compression", "zstd").parquet(f"{folder}/records")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record, from the header's text and the stored payload: page_id, payload_bytes, payload_digest, record_type,
    refers_to, verified, payload_address.

    verified: the payload has the address it is stored under and the digest in the record's header.
    """
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        F.col("address").alias("payload_address"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("address")).alias("right"))
    header = F.decode("warc_header", "UTF-8")
    field = lambda name, value: F.regexp_extract(header, f"\r\n{name}: {value}\r\n", 1)
    records = spark.read.parquet(f"{folder}/records").select(
        "page_id", F.col("address").alias("payload_address"), field("WARC-Type", "([a-z]+)").alias("record_type"), field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("told"),
        F.expr(f"try_cast(nullif(regexp_extract(decode(warc_header, 'UTF-8'), '\\r\\nWARC-Refers-To: <{RECORD_ID}(-?[0-9]+)>\\r\\n', 1), '') AS bigint)").alias("refers_to"))
    return records.join(payloads, "payload_address").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("right") & (F.col("told") == F.col("payload_digest"))).alias("verified"), "payload_address")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record): the exact bytes of every record; a response carries its payload, a revisit its headers only."""
    records = spark.read.parquet(f"{folder}/records")
    own = F.instr(F.decode("warc_header", "UTF-8"), "\r\nWARC-Type: response\r\n") > 0
    end = F.lit(b"\r\n\r\n")
    responses = records.where(own).join(spark.read.parquet(f"{folder}/payloads").select("address", "payload"), "address")
    return responses.select("page_id", F.concat("warc_header", "http_header", "payload", end).alias("record")).unionByName(
        records.where(~own).select("page_id", F.concat("warc_header", "http_header", end).alias("record")))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write the archive to a new folder on shared storage and read it back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write_archive(pages, folder, **options)
    return read_archive(pages.sparkSession, folder)
