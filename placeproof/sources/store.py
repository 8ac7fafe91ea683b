"""Finished profiles on shared storage, one partition per language and profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_PER_PROFILE = 8


def write_profile(table: DataFrame, path: str, lang: str) -> None:
    """Replace the stored profiles that occur in `table`; all others stay. A hot profile is spread over several files."""
    spread = F.pmod(F.col("seq"), F.lit(FILES_PER_PROFILE)) if "seq" in table.columns else F.lit(0)
    table.withColumn("lang", F.lit(lang)).repartition("profile_id", spread).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("lang", "profile_id").parquet(path)


def read_profile(spark: SparkSession, path: str, lang: str, profile_id: int | None = None) -> DataFrame:
    """Stored rows of a language, or of one profile; both filters prune folders."""
    stored = spark.read.parquet(path).filter(F.col("lang") == lang)
    return stored if profile_id is None else stored.filter(F.col("profile_id") == profile_id)
