"""Numbering of sorted rows, list ranking and prefix sums, all distributed.

Numbers come from range partitions: each numbers its own sorted rows, and the counts of the partitions, one row each,
shift them. A list is ranked level by level. Links inside a block of consecutive elements are contracted in its task,
and the heads of the chains that are left form the list of the next level, in fewer blocks. Where a level shrinks too
little, because links lead far away, pointer jumping ranks what is left in a logarithmic number of joins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import cut, prepare

#: Elements of a list that one task contracts, whatever the list's length.
BLOCK = 1 << 17
#: Rows of one running sum; totals of blocks are summed in the same way.
RUN_BITS = 12


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """df with n, the place from 0 of every row in the order of the keys, nulls first."""
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    # one row for each partition
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    placed = rows.withColumn("part", part).join(F.broadcast(before), "part")
    return placed.select(*df.columns, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("n"))


def contract(ids: np.ndarray, follows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each element of a block: weight from it to the end of its chain, what follows that end (-1: nothing), whether
    it is a head, which no element of the block leads to."""
    order = np.argsort(ids)
    at = np.searchsorted(ids, follows, sorter=order)
    jump = order[np.minimum(at, len(ids) - 1)]
    jump = np.where(ids[jump] == follows, jump, -1)
    head = np.ones(len(ids), bool)
    head[jump[jump >= 0]] = False
    ahead, beyond = weights.copy(), follows.copy()
    while len(live := np.flatnonzero(jump >= 0)):
        to = jump[live]
        ahead[live], beyond[live], jump[live] = ahead[live] + ahead[to], beyond[to], jump[to]
    return ahead, beyond, head


def chains(links: DataFrame, blocks: int) -> DataFrame:
    """(id, ahead, beyond, head) of rows (id, follows, weight), contracted in blocks of consecutive ids."""
    prepare(links.sparkSession)

    def run(batches):
        columns = [[], [], []]
        for batch in batches:
            for into, column in zip(columns, batch.columns, strict=True):
                into.append(column.to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        ids, follows, weights = map(np.concatenate, columns)
        ahead, beyond, head = contract(ids, follows, weights)
        for k in range(0, len(ids), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (ids, ahead, beyond, head)], names=["id", "ahead", "beyond", "head"])

    dealt = links.select("id", "follows", "weight").repartitionByRange(blocks, "id")
    return cut(dealt.mapInArrow(run, "id long, ahead long, beyond long, head boolean"), "chains")


def jumped(links: DataFrame, count: int) -> DataFrame:
    """(id, rank) by pointer jumping: each round every element leaps twice as far."""
    step = links.select("id", "follows", F.col("weight").alias("rank"))
    for _ in range(math.ceil(math.log2(max(count, 1)))):
        ahead = step.select(F.col("id").alias("follows"), F.col("follows").alias("beyond"), F.col("rank").alias("more"))
        far = step.join(ahead, "follows", "left")
        step = cut(far.select("id", F.coalesce("beyond", F.lit(-1)).alias("follows"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")), "jump")
    return step.select("id", "rank")


def list_ranks(links: DataFrame, count: int, block: int = BLOCK) -> DataFrame:
    """(id, rank) of a list of ``count`` rows (id, follows): the elements from each one to the list's end, itself included.

    Ids are numbers from 0 up; follows is -1 at the end.
    """
    links = links.select("id", "follows", F.lit(1).cast("long").alias("weight"))
    levels = []
    while True:
        blocks = -(-count // block)
        level = chains(links, max(blocks, 1))
        levels.append(level)
        links = level.where("head").select("id", F.col("beyond").alias("follows"), F.col("ahead").alias("weight"))
        before, count = count, links.count()
        if count <= 1 or count > before // 2:
            break
    ranks = jumped(links, count)
    for level in reversed(levels):
        end = ranks.select(F.col("id").alias("beyond"), F.col("rank").alias("more"))
        rank = F.col("ahead") + F.coalesce("more", F.lit(0))
        ranks = cut(level.join(end, "beyond", "left").select("id", rank.alias("rank")), "ranks")
    return ranks


def prefix_sums(rows: DataFrame, place: str, values: list[str], bits: int = RUN_BITS) -> DataFrame:
    """rows with each value replaced by its sum over all rows up to this one; places are numbers from 0, one row each.

    Runs of 2^bits places are summed apart, and so are the runs of their totals.
    """
    others = [c for c in rows.columns if c not in values]

    def run_sums(df: DataFrame, at: str) -> DataFrame:
        own = Window.partitionBy(F.shiftright(at, bits)).orderBy(at)
        return df.select(*[c for c in df.columns if c not in values], *[F.sum(v).over(own).alias(v) for v in values])

    def totals(df: DataFrame, at: str) -> DataFrame:
        return df.groupBy(F.shiftright(at, bits).alias("run")).agg(*[F.sum(v).alias(v) for v in values])

    def shifted(df: DataFrame, at: str, sums: DataFrame) -> DataFrame:
        """Add what stands before each run."""
        before = sums.select((F.col("run") + 1).alias("run"), *[F.col(v).alias(f"{v}_before") for v in values])
        placed = df.withColumn("run", F.shiftright(at, bits)).join(before, "run", "left")
        keep = [c for c in df.columns if c not in values]
        return placed.select(*keep, *[(F.col(v) + F.coalesce(f"{v}_before", F.lit(0))).alias(v) for v in values])

    first = cut(totals(rows, place), "totals")
    second = totals(first.withColumnRenamed("run", "at"), "at")
    # one row for 2^(2 * bits) places
    second = second.select("run", *[F.sum(v).over(Window.orderBy("run")).alias(v) for v in values])
    first = shifted(run_sums(first.withColumnRenamed("run", "at"), "at"), "at", second).withColumnRenamed("at", "run")
    return shifted(run_sums(rows, place), place, first).select(*others, *values)
