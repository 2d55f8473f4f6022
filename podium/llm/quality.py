"""Operator 10, quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed character n-grams is shared by all grades; ordered thresholds cut its scale:
P(grade > k) = logistic(x . w - t_k) with t_0 < t_1 < ... The operator gives the expected grade and the tail probability
of reaching ``good``, by which documents are selected. Grades are the distinct ratings found, in order, so any number
from two up works. Learning uses a bounded, documented sample: the first MAX_EACH rows of each grade in hash order.

A null text counts as empty (all features zero); null ratings are not learned from; rows sharing a doc_id share the
largest rating; rows without doc_id are scored and never learned from. With fewer than two grades nothing can be told
apart: the tail probability is 1 and every row is kept. Extra columns are kept by ``keep_good``, not read by the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import prepare, map_texts, tidy
from podium.llm.features import frequencies
from podium.llm.toxicity import sampled_texts

SIZES = (1, 2, 3)
BITS = 12
MAX_EACH = 2_500
STEPS = 300
#: Ratings are grades, not measurements: the lowest so many are learned.
MAX_GRADES = 100
PENALTY = 1e-4
#: N-grams taken to be unseen, so that a few odd letters do not decide over a short text.
DOUBT = 300.0
#: Documents whose tail probability is under this are rejected.
SELECT = 0.5


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        return logistic(features(text) @ self.weights - self.thresholds)

    def expected(self, tails: np.ndarray) -> float:
        return float(self.grades[0] + np.diff(self.grades) @ tails)

    def tail(self, tails: np.ndarray, good: int) -> float:
        """Probability of a grade of at least ``good``."""
        below = sum(g < good for g in self.grades)
        return 1.0 if below == 0 else 0.0 if below == len(self.grades) else float(tails[below - 1])


def features(text: str) -> np.ndarray:
    """Hashed character n-grams, and hashed n-grams of the marks "the word before again" and "another word"."""
    words = text.split()
    again = "".join("\x01" if a == b else "\x02" for a, b in zip(words, words[1:], strict=False))
    letters, repeats = frequencies(text, SIZES, BITS, DOUBT), frequencies(again, SIZES, BITS, DOUBT / 5)
    return (letters + repeats) * np.float32(0.7)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of greatest likelihood; adaptive descent.

    ``weight`` is each row's. Thresholds are the first one plus exponentials, so they stay in order throughout.
    """
    w, gaps = np.zeros(x.shape[1]), np.concatenate([[-0.5 * (classes - 2)], np.zeros(classes - 2)])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(gaps), np.zeros_like(gaps)]
    for step in range(1, steps + 1):
        steps_up = np.exp(gaps[1:])
        t = gaps[0] + np.concatenate([[0.0], np.cumsum(steps_up)])
        tail = logistic((x @ w.astype(x.dtype))[:, None] - t)
        upper = np.hstack([np.ones((len(y), 1)), tail])
        lower = np.hstack([tail, np.zeros((len(y), 1))])
        rows = np.arange(len(y))
        a, b = upper[rows, y], lower[rows, y]
        p = np.maximum(a - b, 1e-12)
        # derivative of -log(a - b) by the score, and by each threshold
        da, db = a * (1 - a) / p * weight, b * (1 - b) / p * weight
        by_score = -(da - db)
        by_t = np.array([da[y == k + 1].sum() - db[y == k].sum() for k in range(classes - 1)])
        grad_w = by_score.astype(x.dtype) @ x + PENALTY * w
        grad_gaps = np.concatenate([[by_t.sum()], steps_up * np.cumsum(by_t[::-1])[::-1][1:]])
        for value, grad, i in ((w, grad_w, 0), (gaps, grad_gaps, 2)):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * grad**2
            value -= 0.1 * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-8)
    return w, gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MAX_EACH) -> Model | None:
    prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    known = known.groupBy(F.col("doc_id").alias("key")).agg(F.max(F.col(target).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().orderBy("y").limit(MAX_GRADES).collect()}
    grades = sorted(sizes)
    if len(grades) < 2:
        return None
    chosen = [known.where(F.col("y") == g).orderBy(F.xxhash64("key"), "key").limit(most) for g in grades]
    sample = chosen[0]
    for part in chosen[1:]:
        sample = sample.union(part)

    def reduce(batches):
        for batch in batches:
            at, values = [], []
            for text in batch.column(0):
                row = features(text.as_py())
                at.append(np.flatnonzero(row).astype(np.int16))
                values.append(row[at[-1]])
            ends = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, np.concatenate([*x, np.empty(0, kind)])) for x, kind in ((at, np.int16), (values, np.float32))]
            yield pa.RecordBatch.from_arrays([*lists, batch.column(1)], names=["at", "value", "y"])

    rows = sampled_texts(docs, sample).mapInArrow(tidy(reduce), "at array<smallint>, value array<float>, y int").toArrow()
    y = np.searchsorted(grades, rows.column("y").to_numpy())
    if len(np.unique(y)) < 2:
        return None
    x = np.zeros((len(y), 1 << BITS), np.float32)
    lengths = np.array([len(v) for v in rows.column("at")], np.int64)
    x[np.repeat(np.arange(len(y)), lengths), rows.column("at").combine_chunks().flatten().to_numpy()] = (
        rows.column("value").combine_chunks().flatten().to_numpy()
    )
    # a grade of which only a part was sampled weighs as its share of all ratings
    share = np.array([sizes[g] for g in grades], float) / sum(sizes.values())
    weights, thresholds = fit_ordinal(x, y, (share / np.bincount(y, minlength=len(grades)).clip(1))[y], len(grades))
    return Model(grades, weights, thresholds)


def score_quality(docs: DataFrame, model: Model | None, good: int = 1) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected) of every whole text."""

    def scorer():
        def score(text: str):
            if model is None:
                return None, 1.0, True
            tails = model.tails(text)
            tail = model.tail(tails, good)
            return model.expected(tails), tail, tail >= SELECT

        return score

    return map_texts(docs, scorer, [("expected_grade", "double"), ("tail_probability", "double"), ("selected", "boolean")])


def keep_good(docs: DataFrame, model: Model | None, good: int = 1) -> DataFrame:
    """The rows of docs, all their columns, whose tail probability reaches SELECT."""
    if model is None:
        return docs
    prepare(docs.sparkSession)

    @tidy
    def verdicts(texts):
        for part in texts:
            yield pd.Series([model.tail(model.tails(t or ""), good) >= SELECT for t in part], dtype=bool)

    @F.pandas_udf("boolean")
    def selected(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from verdicts(texts)

    return docs.where(selected(F.col("text").cast("string")))
