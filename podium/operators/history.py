"""Winners, course records, owners over time, head-to-head and weather enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.operators.measures import count_if
from podium.operators.ranking import keep_first

C = F.col

# Codes of entries without a finishing time, and limits of a plausible one.
NOT_FINISHED = ("DNF", "DNS", "OCS", "DSQ", "RAF", "DNC", "RET")
SHORTEST_S, LONGEST_S, FASTEST_KT = 1200, 36000, 7.5
LIGHT_KMH, HEAVY_KMH = 15, 25

# Courses of known length, found by a part of the event name; the first match counts.
FIXED_COURSES = (
    ("boland", "#53 Bolands", 16.7),
    ("leeward", "#52 Leeward Island", 14.2),
    ("tancook", "#50/#51 Tancook Island", 22.2),
    ("r g smith", "#50/#51 Tancook Island", 22.2),
    ("rg smith", "#50/#51 Tancook Island", 22.2),
    ("r.g.smith", "#50/#51 Tancook Island", 22.2),
)


def fixed_course(name: Column | str, rules: Sequence[tuple[str, str, float]] = FIXED_COURSES) -> Column:
    """struct(course, distance_nm) of the first rule found in the name, with or without its dots; null if none is."""
    low = F.lower(C(name) if isinstance(name, str) else name)
    plain = F.replace(low, F.lit("."), F.lit(""))
    hits = [
        F.when(
            F.contains(low, F.lit(part)) | F.contains(plain, F.lit(part)),
            F.struct(F.lit(course).alias("course"), F.lit(miles).alias("distance_nm")),
        )
        for part, course, miles in rules
    ]
    return F.coalesce(*hits)


def plausible_time(seconds: Column, distance_nm: Column) -> Column:
    """A time no shorter than the course allows and not absurdly long."""
    floor = F.greatest(F.lit(SHORTEST_S), F.floor(distance_nm / F.lit(FASTEST_KT) * 3600).cast("int"))
    return (seconds > floor) & (seconds < LONGEST_S)


def yearly_course_times(star: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finishers, non-finishers and the winner's time per key; the first plausible rank-1 row is the winner."""
    out = C("status").isin(*NOT_FINISHED) & C("status").isNotNull()
    timed = ~F.coalesce(out, F.lit(False)) & plausible_time(C("elapsed_s"), C("distance_nm"))
    winner = F.min(F.when(timed & (C("rank") == 1), F.struct("contest_id", "elapsed_s", "entity_id")))
    return (
        star.groupBy(*keys)
        .agg(
            count_if(timed).alias("finishers"),
            count_if(F.coalesce(out, F.lit(False))).alias("unfinished"),
            winner.alias("w"),
        )
        .select(
            *keys,
            "finishers",
            "unfinished",
            C("w.contest_id").alias("contest_id"),
            C("w.elapsed_s").alias("winner_s"),
            C("w.entity_id").alias("winner_id"),
        )
    )


def records(times: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fastest and slowest winner per key."""
    row = F.struct("winner_s", "period", "series_id", "winner_id")
    slow = F.struct("winner_s", (-C("period")).alias("p"), (-C("series_id")).alias("s"), "winner_id")
    return (
        times.where("winner_s IS NOT NULL")
        .groupBy(*keys)
        .agg(F.count("*").alias("timed"), F.min(row).alias("f"), F.max(slow).alias("l"))
        .select(
            *keys,
            "timed",
            C("f.winner_s").alias("fastest_s"),
            C("f.period").alias("fastest_period"),
            C("f.winner_id").alias("fastest_id"),
            C("l.winner_s").alias("slowest_s"),
            (-C("l.p")).alias("slowest_period"),
            C("l.winner_id").alias("slowest_id"),
        )
    )


def preferred_winner(standing_winners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One winner per key: the overall scope first, then the lowest points."""
    scope = F.when(C("scope") == "overall", 0).otherwise(1)
    return keep_first(standing_winners, keys, [scope, C("nett").isNull(), C("nett"), C("entity_id")])


def with_fallback(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``second`` only for keys ``first`` does not know."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def owner_at(wanted: DataFrame, tenures: DataFrame) -> DataFrame:
    """Owner of an entity in a period: the first tenure that covers it, else the last one listed.

    ``wanted`` holds distinct (entity_id, period); open ends count as 0 and 9999. Both choices are mergeable
    aggregates over the tenures of one entity.
    """
    listed = F.struct(F.coalesce("start_period", F.lit(0)).alias("s"), "tenure_id", "owner")
    starts, ends = F.coalesce("start_period", F.lit(0)), F.coalesce("end_period", F.lit(9999))
    covers = C("tenure_id").isNotNull() & C("period").between(starts, ends)
    picked = (
        wanted.join(tenures, "entity_id", "left")
        .groupBy("entity_id", "period")
        .agg(F.min(F.when(covers, listed)).alias("m"), F.max(F.when(C("tenure_id").isNotNull(), listed)).alias("l"))
    )
    return picked.select(
        "entity_id", "period", F.coalesce("m.owner", "l.owner").alias("owner"), C("m").isNotNull().alias("covered")
    )


def head_to_head(best: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared contests, wins, losses and ties of the chosen pairs (pair_id, a_id, b_id) per period.

    Only rows of the chosen entities are kept, and they meet by (pair, contest) in one aggregate, so no pair of
    rows is ever formed.
    """
    sides = pairs.select("pair_id", F.inline(F.array(
        F.struct(F.lit("a").alias("side"), C("a_id").alias("entity_id")),
        F.struct(F.lit("b").alias("side"), C("b_id").alias("entity_id")),
    )))
    met = (
        best.join(sides, "entity_id")
        .groupBy("pair_id", "contest_id", "period")
        .agg(
            F.min(F.when(C("side") == "a", C("rank"))).alias("a"), F.min(F.when(C("side") == "b", C("rank"))).alias("b")
        )
        .where("a IS NOT NULL AND b IS NOT NULL")
    )
    per = met.groupBy("pair_id", "period").agg(
        F.count("*").alias("shared"),
        count_if(C("a") < C("b")).alias("a_wins"),
        count_if(C("a") > C("b")).alias("b_wins"),
        count_if(C("a") == C("b")).alias("ties"),
    )
    return per.join(pairs, "pair_id")


def high_low(levels: DataFrame, keys: Sequence[str], order: str, height: str, single: float) -> DataFrame:
    """Label extremes of a series high and low by turns, starting from the first two heights.

    A group is one day of hourly readings.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy(*keys))
    falls = F.first(height).over(whole) > F.nth_value(height, 2).over(whole)
    even = (F.row_number().over(w) % 2) == 1
    label = F.when(n == 1, F.when(C(height) > single, "high").otherwise("low")).otherwise(
        F.when(even == falls, "high").otherwise("low")
    )
    return levels.withColumn("label", label)
