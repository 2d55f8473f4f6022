"""Operator 5, toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams that occur in a lower-cased whole text. Learning takes two passes over a
bounded, documented sample of labelled rows (the first MAX_EACH of either label in hash order): one counts in Spark in
how many texts of either label each n-gram occurs and keeps the FEATURES most telling ones, the other brings the texts,
reduced to those features, to the driver, where a logistic regression on the features, each scaled by its log-count
ratio, is fitted. Scoring covers every row.

A null text counts as empty and scores as a text without features. Labels that are null are not learned from; rows that
share a doc_id share the label 1 if one of their label rows has it. Without labels of both kinds every score is 0. Rows
without doc_id are scored and never learned from. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import prepare, map_texts
from podium.llm.features import buckets, presence

SIZES = (4, 5)
BITS = 20
MAX_EACH = 4_000
FEATURES = 4_096
THRESHOLD = 0.7
STEPS = 400


@dataclass
class Model:
    wanted: np.ndarray  # number of the feature of each bucket, or -1
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        at = presence(text.lower(), SIZES, BITS, self.wanted)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at].sum() + self.bias, -50, 50))))


def sample(labels: DataFrame, learn: Column, target: str, most: int = MAX_EACH) -> DataFrame:
    """(key, y) of at most ``most`` labelled rows of each class, first in hash order."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    known = known.groupBy(F.col("doc_id").alias("key")).agg(F.max(F.col(target).cast("int")).alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(most) for y in (0, 1)]
    return parts[0].union(parts[1])


def sampled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(text, y): the sampled rows' whole texts. The sample has a fixed bound, so it may be broadcast."""
    own = docs.select(F.col("doc_id").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(chosen), "key").select("text", "y")


def feature_counts(texts: DataFrame) -> DataFrame:
    """(bucket, y, n): in how many texts of either class each n-gram occurs; counted inside tasks first."""

    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = np.zeros(1 << BITS, bool)
                for found in buckets(text.lower(), SIZES, BITS):
                    seen[found] = True
                counts[y] += seen
        for y in (0, 1):
            at = np.flatnonzero(counts[y])
            for part in np.array_split(at, max(1, len(at) >> 16)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(np.full(len(part), y), pa.int32()), pa.array(counts[y][part], pa.int64())],
                    names=["bucket", "y", "n"],
                )

    part = texts.mapInArrow(run, "bucket int, y int, n long")
    return part.groupBy("bucket").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "toxic") -> Model | None:
    prepare(docs.sparkSession)
    texts = sampled_texts(docs, sample(labels, learn, target))
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    n0, n1 = sizes[0], sizes[1]
    share0, share1 = (F.col("n0") + 1) / (n0 + 2), (F.col("n1") + 1) / (n1 + 2)
    both = (F.col("n0") + F.col("n1") + 2) / (n0 + n1 + 4)
    # how far apart the classes are, in standard errors
    z = F.abs(share1 - share0) / F.sqrt(both * (1 - both) * (1 / n0 + 1 / n1))
    kept = (
        feature_counts(texts)
        .select("bucket", z.alias("z"), F.log(share1 / share0).alias("ratio"))
        .orderBy(F.col("z").desc(), "bucket")
        .limit(FEATURES)
        .orderBy("bucket")
        .collect()
    )
    wanted = np.full(1 << BITS, -1, np.int16)
    wanted[[r["bucket"] for r in kept]] = np.arange(len(kept))
    ratio = np.array([r["ratio"] for r in kept])

    def reduce(batches):
        for batch in batches:
            rows = [presence(t.lower(), SIZES, BITS, wanted).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int16())), batch.column(1)], names=["at", "y"])

    rows = texts.mapInArrow(reduce, "at array<smallint>, y int").toArrow()
    y = rows.column("y").to_numpy()
    lengths = np.array([len(x) for x in rows.column("at")], np.int64)
    of = np.repeat(np.arange(len(y)), lengths)
    at = rows.column("at").combine_chunks().flatten().to_numpy()
    weights, bias = logistic(of, at, ratio, y, n0, n1)
    return Model(wanted, weights, bias)


def logistic(of, at, ratio, y, n0, n1, penalty: float = 1.0, steps: int = STEPS):
    """Weights of a logistic regression on the scaled features, both classes weighing the same; accelerated descent."""
    scaled = np.clip(ratio, -4, 4)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    per_row = np.bincount(of, weights=scaled[at] ** 2, minlength=len(y))
    rate = 1 / (0.25 * (weight * (per_row + 1)).sum() + penalty / (n0 + n1))
    w, b = np.zeros(len(ratio)), 0.0
    w_ahead, b_ahead, t = w, b, 1.0
    for _ in range(steps):
        margin = np.bincount(of, weights=(w_ahead * scaled)[at], minlength=len(y)) + b_ahead
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y)
        gradient = np.bincount(at, weights=error[of], minlength=len(ratio)) * scaled + penalty / (n0 + n1) * w_ahead
        w_new, b_new = w_ahead - rate * gradient, b_ahead - rate * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_ahead = w_new + (t - 1) / t_new * (w_new - w)
        b_ahead = b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w * scaled, b


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""

    def scorer():
        return lambda text: (s := model.score(text) if model else 0.0, int(s >= THRESHOLD))

    return map_texts(docs, scorer, [("score", "double"), ("predicted", "int")])
