"""Dedup-then-aggregate boards, owner roll-ups, cohorts and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.operators.measures import half_up, podiums, wins


def best_rank(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with the best rank, so that a second entry in a contest does not count twice."""
    return results.groupBy(*keys).agg(F.min("rank").alias("rank"))


def tally(best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contests, wins, podiums and mean rank per key."""
    return best.groupBy(*keys).agg(
        F.count("*").alias("contests"),
        wins().alias("wins"),
        podiums().alias("podiums"),
        half_up(F.sum("rank"), F.count("rank"), 2).alias("avg_rank"),
    )


def owner_key(owner: Column, entity: Column) -> Column:
    """Owner, or the entity itself where no owner is known."""
    return F.coalesce(owner, F.concat(F.lit("boat:"), entity.cast("string")))


def with_owner(board: DataFrame, entities: DataFrame) -> DataFrame:
    named = entities.select("entity_id", owner_key(F.col("owner"), F.col("entity_id")).alias("owner_key"))
    return board.join(named, "entity_id")


def rollup_sum(board: DataFrame, entities: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Board summed to owner grain."""
    return with_owner(board, entities).groupBy("owner_key").agg(
        F.count("*").alias("members"), *[F.sum(c).alias(c) for c in sums]
    )


def rollup_weighted(board: DataFrame, entities: DataFrame, value: str, weight: str) -> DataFrame:
    """Weighted mean, at owner grain, of values already rounded to tenths."""
    tenths = F.round(F.col(value) * 10).cast("long")
    return (
        with_owner(board, entities)
        .groupBy("owner_key")
        .agg(F.sum(tenths * F.col(weight)).alias("_v"), F.sum(weight).alias(weight))
        .select("owner_key", weight, half_up("_v", F.col(weight) * 10, 1).alias(value))
    )


def rollup_periods(seen: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct periods of an owner over all their entities."""
    once = with_owner(seen, entities).select("owner_key", "period").distinct()
    return once.groupBy("owner_key").agg(
        F.count("*").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period")
    )


def next_period(periods: DataFrame) -> DataFrame:
    """Each observed period with the next one observed. The input is a calendar: one row per period."""
    return periods.withColumn("next_period", F.lead("period").over(Window.partitionBy(F.lit(0)).orderBy("period")))


def returning(seen: DataFrame) -> DataFrame:
    """Entities per period and how many of them come back in the next observed period.

    ``seen`` holds distinct (entity_id, period).
    """
    calendar = next_period(seen.select("period").distinct())
    due = seen.join(calendar, "period").select("entity_id", "period", "next_period")
    back = seen.select("entity_id", F.col("period").alias("next_period"), F.lit(1).alias("back"))
    return (
        due.join(back, ["entity_id", "next_period"], "left")
        .groupBy("period", "next_period")
        .agg(F.count("*").alias("entities"), F.count("back").alias("returning"))
        .where(F.col("next_period").isNotNull())
    )


def first_seen(seen: DataFrame) -> DataFrame:
    """New entities per period."""
    first = seen.groupBy("entity_id").agg(F.min("period").alias("period"))
    return first.groupBy("period").agg(F.count("*").alias("newcomers"))


def longest_run(seen: DataFrame, key: str = "entity_id", at_least: int = 3) -> DataFrame:
    """Longest run of consecutive whole-number periods per key; the earliest run on ties.

    ``seen`` holds distinct (key, period), so a window group is no longer than the calendar.
    """
    island = F.col("period") - F.row_number().over(Window.partitionBy(key).orderBy("period"))
    runs = seen.withColumn("_i", island).groupBy(key, "_i").agg(
        F.count("*").alias("length"), F.min("period").alias("start"), F.max("period").alias("end")
    )
    best = runs.groupBy(key).agg(F.max(F.struct("length", (-F.col("start")).alias("s"), "start", "end")).alias("b"))
    return best.select(key, "b.length", "b.start", "b.end").where(F.col("length") >= at_least)


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Element n//2 of each group in order, from counts per distinct value; no group is gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(value)
    total = Window.partitionBy(*keys)
    placed = counts.withColumn("_upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(total))
    middle = F.floor(F.col("n") / 2)
    return placed.where((F.col("_upto") > middle) & (F.col("_upto") - F.col("c") <= middle)).select(
        *keys, "n", F.col(value).alias("median")
    )
