"""Operator 7, language identification: family first, then one-versus-one linear support vector machines within it.

Features are the square roots of the relative frequencies of hashed character n-grams of the lower-cased whole text, a
vector of length 1. A machine for each pair of families votes for the family; machines for each pair of its languages
vote for the language. A language that no family lists is a family of its own. Learning uses a bounded, documented
sample: the first MAX_EACH rows of each language in hash order.

A text that is null or has no letter is ``und`` with score 0, and so is everything where no language could be learned.
Null languages are not learned from; rows sharing a doc_id are single examples each; rows without doc_id are predicted
and never learned from. Ties of votes go to the larger summed margin, then to the first name. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import prepare, map_texts
from podium.llm.features import frequencies

# Families of languages, by their codes.
FAMILIES = {
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "germanic": ["en", "de", "nl", "sv", "da", "no", "af"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"],
}
SIZES = (1, 2, 3)
BITS = 12
MAX_EACH = 1_500
#: More languages than this are not expected; the most frequent ones are learned.
MAX_LANGUAGES = 400
PENALTY = 1e-4
STEPS = 150
UNKNOWN = "und"


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def features(text: str) -> np.ndarray:
    return frequencies(text.lower(), SIZES, BITS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss; y is 1 or -1, both sides weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    rate = 1 / (2 * (weight @ (x**2).sum(1)) + PENALTY)
    w = np.zeros(x.shape[1])
    ahead, t = w, 1.0
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ ahead.astype(x.dtype)))
        new = ahead - rate * (-2 * ((weight * y * slack).astype(x.dtype) @ x) + PENALTY * ahead)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


@dataclass
class Duel:
    """One-versus-one machines among names."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Duel:
        names = sorted(set(y))
        pairs, rows = [], []
        for i, j in combinations(range(len(names)), 2):
            on = np.isin(y, (names[i], names[j]))
            rows.append(fit_machine(x[on], np.where(y[on] == names[i], 1.0, -1.0)))
            pairs.append((i, j))
        return cls(names, pairs, np.array(rows) if rows else None)

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """The winner and how sure its closest duel was, 0.5 to 1."""
        if self.weights is None:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, sums = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (i, j), m in zip(self.pairs, margins, strict=True):
            votes[i if m >= 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        best = max(range(len(self.names)), key=lambda k: (votes[k], sums[k], -k))
        won = [m if i == best else -m for (i, j), m in zip(self.pairs, margins, strict=True) if best in (i, j)]
        return self.names[best], float(1 / (1 + np.exp(-2 * max(min(won), 0.0))))


@dataclass
class Model:
    families: Duel
    languages: dict[str, Duel]

    def predict(self, text: str) -> tuple[str, float]:
        if not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self.families.decide(x)
        language, surer = self.languages[family].decide(x)
        return language, sure * surer


def fit(docs: DataFrame, learn: Column) -> Model | None:
    """Learn from the rows (doc_id, text, lang) for which ``learn`` holds."""
    prepare(docs.sparkSession)
    rows = docs.where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy(F.col("lang").alias("language")).count().orderBy(F.col("count").desc(), "language")
    languages = sorted(r["language"] for r in counts.limit(MAX_LANGUAGES).collect())
    if not languages:
        return None
    keys = rows.select(F.col("doc_id").alias("key"), F.col("lang").alias("language")).distinct()
    chosen = None
    for language in languages:
        part = keys.where(F.col("language") == language).orderBy(F.xxhash64("key"), "key").limit(MAX_EACH)
        chosen = part if chosen is None else chosen.union(part)
    # the sample has a fixed bound, so it may be broadcast
    texts = rows.select(F.col("doc_id").alias("key"), F.col("lang").alias("language"), F.col("text").cast("string"))
    texts = texts.join(F.broadcast(chosen), ["key", "language"]).select(F.coalesce("text", F.lit("")).alias("text"), "language")

    def reduce(batches):
        for batch in batches:
            found = [(features(t), y) for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            at = [np.flatnonzero(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a.tolist() for a in at], pa.list_(pa.int16())),
                    pa.array([x[a].tolist() for (x, _), a in zip(found, at, strict=True)], pa.list_(pa.float32())),
                    pa.array([y for _, y in found], pa.string()),
                ],
                names=["at", "value", "y"],
            )

    data = texts.mapInArrow(reduce, "at array<smallint>, value array<float>, y string").toArrow()
    if not data.num_rows:
        return None
    y = np.array(data.column("y").to_pylist(), dtype=object)
    x = np.zeros((len(y), 1 << BITS), np.float32)
    lengths = np.array([len(v) for v in data.column("at")], np.int64)
    x[np.repeat(np.arange(len(y)), lengths), data.column("at").combine_chunks().flatten().to_numpy()] = (
        data.column("value").combine_chunks().flatten().to_numpy()
    )
    groups = np.array([family_of(v) for v in y], dtype=object)
    return Model(Duel.fit(x, groups), {g: Duel.fit(x[groups == g], y[groups == g]) for g in sorted(set(groups))})


def predict_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def predictor():
        return lambda text: model.predict(text) if model else (UNKNOWN, 0.0)

    return map_texts(docs, predictor, [("lang_pred", "string"), ("score", "double")])
