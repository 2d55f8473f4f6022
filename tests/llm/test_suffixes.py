from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.llm import suffixes, windows

LENGTH = suffixes.LENGTH


def covered(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + LENGTH] for d in data for k in range(len(d) - LENGTH + 1))
    masks = []
    for d in data:
        mask = np.zeros(len(d), bool)
        for k in range(len(d) - LENGTH + 1):
            if seen[d[k : k + LENGTH]] > 1:
                mask[k : k + LENGTH] = True
        masks.append(mask)
    return data, masks


def check(rows, texts):
    data, masks = covered(texts)
    for row, d, mask in zip(rows, data, masks, strict=True):
        left = bytes(np.frombuffer(d, np.uint8)[~mask])
        runs = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        want = (len(d), int(mask.sum()), runs, hashlib.sha256(left).hexdigest())
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == want


@pytest.fixture
def texts(prose):
    passage, long = prose(60), prose(400)
    return [
        prose(200), f"{prose(30)} {passage} {prose(20)}", f"{prose(9)} {passage}", long, long[50:900] + prose(30), "x" * 199, "x" * 199,
        "y" * 200, "z" * 201, "ab" * 500, None, "", "é" * 150, "é" * 99 + "a", passage[:LENGTH], passage[1 : LENGTH + 2], prose(3), long,
        f"{passage[:230]}{prose(20)}{passage[-230:]}", "Is onhe. " * 2_000,
    ]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_against_brute_force(docs_of, texts, batches):
    check(suffixes.digests(docs_of(texts), batches).orderBy("doc_id").collect(), texts)


def test_many_runs_of_one_start(docs_of, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 3)
    passage = prose(48)
    texts = [f"{prose(40)} {passage} {prose(40)}" for _ in range(25)] + [f"{prose(5)} {passage[30:]} {prose(5)}"]
    check(suffixes.digests(docs_of(texts)).orderBy("doc_id").collect(), texts)


def test_repeated_and_missing_doc_ids(docs_of, prose):
    one, two = prose(100), prose(100)
    rows = [(1, one), (1, two), (1, two), (None, one), (None, prose(90))]
    got = suffixes.digests(docs_of(rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"] == r["n_removed"]) for r in got) == [
        ("1", True), ("1", True), ("1", True), ("None", False), ("None", True),
    ]
    assert suffixes.digests(docs_of([])).count() == 0


def test_without_repeats(docs_of, prose):
    passage = prose(70)
    texts = [f"é{passage}é {prose(4)}", f"a{passage}b", None, "short"]
    docs = docs_of(texts)
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns
    rows = {r["doc_id"]: r for r in left.collect()}
    assert passage not in rows[0]["text"] and rows[0]["text"].startswith("é") and rows[1]["text"] in ("ab", "a", "b")
    assert rows[2]["text"] is None and rows[3]["text"] == "short" and rows[3]["n_chars"] == 5
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows.values())


def test_levels_merge_geometrically(spark):
    family = suffixes.Family()
    for k in range(5):
        rows = [(f, 0, 0, 0) for f in (k, k + 1, 100)]
        found = family.add(spark.createDataFrame(rows, "first long, run long, did long, place long"))
        assert {r["first"] for r in found.collect()} == (set() if k == 0 else {k, 100})
    assert sorted(family.levels) == [0, 2]


def test_long_texts_work_in_pieces(monkeypatch):
    data = np.random.default_rng(4).integers(97, 101, 5_000).astype(np.uint8)
    whole = windows.anchors(data, LENGTH)
    monkeypatch.setattr(windows, "PIECE", 700)
    parts = windows.anchors(data, LENGTH)
    assert parts[2][0] == 0 and parts[3][-1] == len(data) - LENGTH
    assert (parts[2][1:] == parts[3][:-1] + 1).all()
    for _, _, lo, hi, at in zip(*parts, strict=True):
        k = np.searchsorted(whole[2], lo, side="right") - 1
        assert at == whole[4][k] and hi <= whole[3][k]
    starts = np.arange(0, len(data) - LENGTH + 1, 3)
    pieced = windows.window_hashes(data, starts, LENGTH)
    monkeypatch.undo()
    assert (pieced == windows.window_hashes(data, starts, LENGTH)).all()


def test_texts_under_one_doc_id_whose_hashes_begin_alike(spark, docs_of):
    many = spark.range(20_000).select(F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(5)]).alias("text"))
    pair = many.groupBy(F.shiftrightunsigned(F.xxhash64("text"), 40)).agg(F.sort_array(F.collect_list("text")).alias("texts")).where("size(texts) > 1")
    one, two = pair.first()["texts"][:2]
    for key in (None, 5):
        got = {r["doc_id"]: r for r in suffixes.digests(docs_of([(key, one), (9, one)])).collect()}
        assert {r["n_removed"] for r in got.values()} == {len(one)}
        left = suffixes.without_repeats(docs_of([(key, one), (key, two), (9, one)])).collect()
        assert sorted(r["text"] for r in left) == ["", "", two]


def test_a_line_that_stands_often_in_each_text_is_one_row_for_each(spark, docs_of, prose):
    line = prose(60) + "\n"
    texts = [line * 9 + prose(40 + k) + line * 4 for k in range(12)] + [prose(90), line[7:], None]
    rows = suffixes.keyed(docs_of(texts))
    found = suffixes.candidates(rows, 2)
    assert found.select("first", "run", "did", "th").distinct().count() == found.count()
    every = suffixes.suffixes(rows).join(found.select("first").distinct(), "first", "left_semi")
    places = found.select("first", "run", "did", "th", F.explode("places").alias("place"))
    assert places.exceptAll(every.select(*places.columns)).count() == every.select(*places.columns).exceptAll(places).count() == 0
    whole = suffixes.repeated_spans(rows)
    assert whole.select("did", "th", "places").count() < every.count() / 2
    check(suffixes.digests(docs_of(texts)).orderBy("doc_id").collect(), texts)


def test_many_rows_of_one_id_and_text_are_spans_of_one_text(docs_of, prose):
    text = prose(100)
    docs = docs_of([(None, text)] * 300 + [(4, prose(50))])
    spans = suffixes.joined_spans(suffixes.repeated_spans(suffixes.keyed(docs))).collect()
    assert len(spans) == 1 and len({tuple(s) for s in spans[0]["spans"]}) == len(spans[0]["spans"])
    assert suffixes.union_of(spans[0]["spans"]) == [(0, len(text))]
