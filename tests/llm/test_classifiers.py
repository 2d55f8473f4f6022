from __future__ import annotations

import os
import random

import numpy as np
import pytest

from podium.llm import language, quality, toxicity
from podium.llm import queries as registered
from podium.llm.common import read, remainder

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = read(spark, SF_DIR, "documents").join(read(spark, SF_DIR, "labels"), "doc_id")
    return {r["doc_id"]: r for r in rows.collect()}


def test_toxicity_on_held_out_rows(spark, labelled):
    held = [r for r in registered.op5_toxicity(spark, SF_DIR).collect() if r["held_out"] and r["doc_id"] in labelled]
    assert len(held) > 80
    wrong = [r for r in held if r["predicted"] == 1 and labelled[r["doc_id"]]["toxic"] == 0]
    assert not wrong
    order = sorted(held, key=lambda r: -r["score"])
    toxic = sum(labelled[r["doc_id"]]["toxic"] for r in held)
    assert sum(labelled[r["doc_id"]]["toxic"] for r in order[:toxic]) >= 0.7 * toxic
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in held)


def test_language_on_held_out_rows(spark):
    languages = {r["doc_id"]: r["lang"] for r in read(spark, SF_DIR, "documents").select("doc_id", "lang").collect()}
    held = [r for r in registered.op7_language(spark, SF_DIR).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == languages[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_quality_ranks_and_keeps(spark, labelled):
    rows = [r for r in registered.op10_quality(spark, SF_DIR).collect() if r["doc_id"] in labelled]
    good = [r for r in rows if labelled[r["doc_id"]]["quality"] == 1]
    bad = [r for r in rows if labelled[r["doc_id"]]["quality"] == 0]
    assert sum(r["selected"] for r in good) >= 0.99 * len(good)
    assert sum(not r["selected"] for r in bad) >= 0.8 * len(bad)


def test_ordinal_regression_on_four_grades():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((3_000, 8)).astype(np.float32)
    scale = x @ np.arange(8) / 4 + rnd.logistic(size=3_000) * 0.3
    y = np.digitize(scale, [-3, 0, 2])
    weights, thresholds = quality.fit_ordinal(x, y, np.full(len(y), 1 / len(y)), 4, steps=600)
    assert (np.diff(thresholds) > 0).all()
    model = quality.Model([1, 2, 3, 5], weights, thresholds)
    tails = quality.logistic((x @ weights)[:, None] - thresholds)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(axis=1), y)[0, 1] > 0.9
    assert model.tail(tails[0], 1) == 1 and model.tail(tails[0], 6) == 0 and model.tail(tails[0], 5) == tails[0][2]
    assert model.expected(np.array([1.0, 1.0, 1.0])) == 5


LABELS = "doc_id long, quality int, toxic int, y string"


def test_odd_rows_and_empty_tables(spark, docs_of):
    docs = docs_of([(None, "x"), (1, None), (2, ""), (3, "12 !?"), (3, "12 !?"), (4, "word " * 60_000)])
    none = spark.createDataFrame([], LABELS)
    nulls = spark.createDataFrame([(1, None, None, ""), (None, 1, 1, ""), (2, 1, 0, ""), (2, 1, 0, "")], LABELS)
    for labels in (none, nulls):
        model = toxicity.fit(docs, labels, remainder("doc_id", 3) != 99)
        assert [(r["score"], r["predicted"]) for r in toxicity.score_toxicity(docs, model).collect()] == [(0.0, 0)] * 6
        model = quality.fit(docs, labels)
        assert {r["selected"] for r in quality.score_quality(docs, model).collect()} == {True}
        assert quality.keep_good(docs, model).columns == docs.columns
    model = language.fit(docs, remainder("doc_id", 4) != 99)
    assert {(r["lang_pred"], r["score"]) for r in language.predict_language(docs, model).collect()} == {("und", 0.0)}


def test_learned_models_take_odd_texts(spark, docs_of):
    rnd = random.Random(2)
    kind = {"en": "the of and thing", "de": "der die und ung", "fr": "le de et eau", "xx": "zq qz zzq q"}
    rows = [(k, lang, " ".join(rnd.choices(words.split(), k=30))) for k, (lang, words) in enumerate(list(kind.items()) * 20)]
    docs = spark.createDataFrame([(k, t, lang) for k, lang, t in rows], "doc_id long, text string, lang string")
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    got = language.predict_language(docs, model).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][1] and 0 < r["score"] <= 1 for r in got)
    odd = language.predict_language(docs_of([None, "", "123 %", "the " * 100_000]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd] == ["und", "und", "und", "en"]
    labels = spark.createDataFrame([(k, int(k % 4 == 0), int(k % 4 == 0), "") for k in range(80)], LABELS)
    graded = quality.fit(docs, labels)
    assert {r["doc_id"] for r in quality.keep_good(docs, graded).collect()} == set(range(0, 80, 4))
    toxic = toxicity.fit(docs, labels, remainder("doc_id", 3) != 1)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in toxicity.score_toxicity(docs, toxic).collect())
    assert os.path.isdir(SF_DIR)
