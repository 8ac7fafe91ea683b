"""Model spend: cost, daily totals and which requests a budget admits. Money is counted in whole micro-dollars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.operators.skew import BLOCK_ROWS, running_before
from placeproof.session import cut_lineage

# Micro-dollars per token, i.e. dollars per million tokens; an unknown model counts as the dearest.
PRICES = {"small": (1, 5), "medium": (2, 10), "large": (5, 25)}
DEAREST = "large"
SEARCH_MICRO_USD = 10_000


def cost_micro_usd(model: Column, input_tokens: Column, output_tokens: Column, searches: Column) -> Column:
    def price(index: int) -> Column:
        table = F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, p[index])])
        return F.coalesce(F.element_at(table, model), F.lit(PRICES[DEAREST][index]))
    return (input_tokens * price(0) + output_tokens * price(1) + searches * SEARCH_MICRO_USD).cast("bigint")


def with_cost(usage: DataFrame) -> DataFrame:
    return usage.withColumn("cost", cost_micro_usd(
        F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("web_searches")))


def user_usage(usage: DataFrame, user_cap: int) -> DataFrame:
    """Per day and user: spent and what is left of the cap."""
    return with_cost(usage).groupBy("day", "user_id").agg(F.sum("cost").alias("spent")).withColumn(
        "remaining", F.greatest(F.lit(0), F.lit(user_cap) - F.col("spent")))


def daily_usage(usage: DataFrame) -> DataFrame:
    """Per day: total, calls, tokens and number of users, by way of one small row per user."""
    per_user = with_cost(usage).groupBy("day", "user_id").agg(
        F.sum("cost").alias("cost"), F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))
    return per_user.groupBy("day").agg(
        F.sum("cost").alias("total"), F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("users"))


def spend_admission(usage: DataFrame, user_cap: int, day_cap: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each request with `admitted`: a cap is checked against earlier admitted spend, and the cost is booked afterwards.

    Spend only grows, so once a cap is reached every later request of that user or day is refused as well. Prior spend
    of all earlier requests therefore decides the same as prior spend of the admitted ones: first per user, then per day
    over the survivors.
    """
    costed = with_cost(usage)
    by_user = running_before(costed, ["day", "user_id"], "seq", {"user_before": F.col("cost")}, "sum", block_rows)
    passed = F.coalesce("user_before", F.lit(0)) < user_cap
    counted = cut_lineage(by_user.withColumn("user_ok", passed).withColumn(
        "booked", F.when(passed, F.col("cost")).otherwise(0)))
    by_day = running_before(counted, ["day"], "seq", {"day_before": F.col("booked")}, "sum", block_rows)
    return by_day.withColumn("admitted", F.col("user_ok") & (F.coalesce("day_before", F.lit(0)) < day_cap)).drop(
        "user_before", "day_before", "user_ok", "booked")
