"""Connected components of a link table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every end of a link (a, b): the label is the smallest node that links reach.

    Each round, every node points to its smallest neighbour if that is smaller, pointers are followed to their ends, and
    links move to those ends; links inside one component vanish. A star of any size takes one round. Pre-aggregated
    minima and joins of written tables keep a node with very many links from loading one task. Links with a null end
    or with both ends alike join nothing.
    """
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = cut(
        links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("label")),
        "labels",
    )
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        step = both.groupBy("node").agg(F.min("other").alias("least"))
        step = cut(step.select("node", F.least("node", "least").alias("end")), "step")
        moved = True
        while moved:
            ends = step.select(F.col("node").alias("end"), F.col("end").alias("next"))
            step = cut(step.join(ends, "end").select("node", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")), "step")
            moved = not step.where("moved").isEmpty()
            step = step.select("node", "end")
        for end in ("a", "b"):
            to = step.select(F.col("node").alias(end), F.col("end").alias("to"))
            links = links.join(to, end).select(*[F.col("to").alias(c) if c == end else F.col(c) for c in ("a", "b")])
        links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        to = step.select(F.col("node").alias("label"), F.col("end").alias("to"))
        labels = cut(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    return labels
