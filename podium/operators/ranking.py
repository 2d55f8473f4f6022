"""Ranking and keep-one operators that stay distributed when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

MAX_HOT = 1000  # hot groups kept on the driver; also the row bound of what is broadcast
TRACKED = 20_000  # counters of the sketch: a group with over 0.02 % of all rows is found
CUTS = 255
SAMPLE = 100_000  # rows from which the cuts of all hot groups are chosen


def hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int) -> list[int]:
    """Hashes of the groups that hold at least ``hot_rows`` rows, found with one mergeable sketch.

    The list only decides how rows are routed, never what the result is: a group missed by the sketch is
    ranked in one piece. At most ``MAX_HOT`` numbers reach the driver.
    """
    sketch = df.select(F.xxhash64(*group).alias("h")).agg(
        F.expr(f"approx_top_k(h, {MAX_HOT}, {TRACKED})").alias("top")
    )
    rows = sketch.select(F.explode("top").alias("t")).where(F.col("t.count") >= hot_rows).collect()
    return sorted(r.t["item"] for r in rows)


def _cuts(hashed: DataFrame, hot: DataFrame, value: Column, hot_rows: int) -> DataFrame:
    """Points, in ranking order, that cut each hot group into pieces of about ``hot_rows`` rows.

    They come from a bounded sample and are fixed here once, so every later use sees the same ranges. Any points
    give right ranks; good ones give even pieces. Being whole order keys, they also cut rows that tie in the
    leading column.
    """
    keyed = hashed.join(F.broadcast(hot), "_h").select("_h", value.alias("k"))
    sizes = {r["_h"]: r["count"] for r in keyed.groupBy("_h").count().collect()}  # at most MAX_HOT rows
    every = max(1, sum(sizes.values()) // SAMPLE)
    sample = keyed.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).limit(4 * SAMPLE).collect()
    found: dict[int, list[tuple]] = {h: [] for h in sizes}
    for r in sample:
        found[r["_h"]].append(tuple(r["k"]))
    rows = []
    for h, keys in found.items():
        keys.sort(key=lambda k: tuple((x is not None, x) for x in k))
        pieces = min(CUTS + 1, len(keys) + 1, -(-sizes[h] // hot_rows))
        rows.append((h, [keys[i * len(keys) // pieces] for i in range(1, pieces)]))
    ddl = StructType([StructField("_h", LongType()), StructField("_cuts", ArrayType(keyed.schema["k"].dataType))])
    return hashed.sparkSession.createDataFrame(rows, ddl)


def rank_within(
    df: DataFrame,
    group: Sequence[str],
    lead: str,
    ties: Sequence[Column],
    *,
    descending: bool = False,
    out: str = "rank",
    hot_rows: int = 2_000_000,
    hot: list[int] | None = None,
    hot_on: Sequence[str] | None = None,
) -> DataFrame:
    """1..n per group, as a long, ordered by numeric ``lead`` (not null), then ``ties``.

    Without hot groups this is a plain ``row_number``. A hot group is cut into ranges of its order; each range is
    numbered on its own and shifted by the exact row count of the ranges before it. ``hot`` may be handed
    in when it is known already; ``hot_on`` then names the columns it was found on.
    """
    group = list(group)
    order = [F.col(lead).desc() if descending else F.col(lead).asc(), *ties]
    if hot is None:
        hot = hot_groups(df, group, hot_rows)
    if not hot:
        number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return df.withColumn(out, number.cast("long"))

    spark = df.sparkSession
    hashed = df.withColumn("_h", F.xxhash64(*(hot_on or group)))
    value = F.struct(
        (-F.col(lead) if descending else F.col(lead)).alias("k0"), *[c.alias(f"k{i}") for i, c in enumerate(ties, 1)]
    )
    cut_df = F.broadcast(_cuts(hashed, spark.createDataFrame([(h,) for h in hot], "_h long"), value, hot_rows))
    cut = hashed.join(cut_df, "_h", "left").withColumn(
        "_range", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < value)))
    )
    prior = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        cut.where(F.col("_cuts").isNotNull())
        .groupBy(*group, "_range")
        .count()
        .withColumn("_shift", F.coalesce(F.sum("count").over(prior), F.lit(0)))
        .drop("count")
    )
    numbered = cut.drop("_cuts").withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    )
    # the numbered rows are partitioned by this key already, so only the few counts move
    return (
        numbered.join(shift, [*group, "_range"], "left")
        .withColumn(out, F.col("_rn") + F.coalesce("_shift", F.lit(0)))
        .drop("_h", "_range", "_rn", "_shift")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the smallest by ``order``. A mergeable aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = F.min(F.struct(ordering.alias("o"), F.struct(*rest).alias("v"))).alias("m")
    return df.groupBy(*keys).agg(picked).select(*keys, "m.v.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the largest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = F.max(F.struct(ordering.alias("o"), F.struct(*rest).alias("v"))).alias("m")
    return df.groupBy(*keys).agg(picked).select(*keys, "m.v.*")


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """First ``n`` rows per group; Spark cuts each partition to n before the shuffle (WindowGroupLimit)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= n)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k; ``order`` must end in a unique key."""
    return df.orderBy(*order).limit(k)
