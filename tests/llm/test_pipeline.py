from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from podium.llm import bpe, decontam, quality, simhash, suffixes
from podium.llm.common import cut, read
from podium.llm.queries import QUERIES, SQL, vocabulary
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_oracle(spark, name):
    assert compare(spark, connect(SF_DIR), QUERIES[name], SQL[name], SF_DIR) == []


def test_stages_follow_each_other(spark):
    """Each stage's rows against its operator's own verdicts, and all of them against run()."""
    docs = read(spark, SF_DIR, "documents")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF_DIR)
        rows = {r["doc_id"]: r for r in docs.collect()}
        if number < 4:
            assert after.columns == columns
            after = cut(after, "test")
        got = {r["doc_id"]: r for r in after.collect()}
        if number == 0:
            scores = quality.score_quality(docs, quality.fit(docs, read(spark, SF_DIR, "labels")))
            assert set(got) == {r["doc_id"] for r in scores.where("selected").collect()}
        elif number == 1:
            groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5, (4, 5)).collect()}
            assert set(got) == set(groups.values())
        elif number == 2:
            removed = {r["doc_id"]: r for r in suffixes.digests(docs).collect()}
            assert set(got) == set(rows)
            for key, row in got.items():
                if removed[key]["n_removed"] == 0:
                    assert row["text"] == rows[key]["text"]
        elif number == 3:
            leaks = {r["doc_id"] for r in decontam.judge(docs, read(spark, SF_DIR, "benchmark")).where("contaminated").collect()}
            assert set(got) == set(rows) - leaks
        else:
            coder = bpe.coder(vocabulary())
            for key, row in got.items():
                assert row["decoded_sha256"] == hashlib.sha256(rows[key]["text"].encode()).hexdigest()
                assert row["ids"] == coder.encode([rows[key]["text"]])[0].tolist()
            whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
            assert whole == {key: row["ids_sha256"] for key, row in got.items()}
        docs = after


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_all_stages(spark, empty):
    """Nulls in any column, repeated rows and ids, empty and very long texts, and columns with the operators' own names."""
    docs = read(spark, SF_DIR, "documents").limit(0 if empty else 40)
    for name in ("fp", "node", "label", "score", "grade", "key", "spans", "kept_id", "bit", "ids"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    if not empty:
        columns = [c for c in docs.columns if c not in ("doc_id", "text")]
        odd = [(None, None), (None, "a text without an id"), (900_001, None), (900_002, ""), (900_003, "word " * 30_000), (900_004, "same"), (900_004, "same")]
        rows = [(*row, *[None] * len(columns)) for row in odd]
        kinds = ", ".join(f"{c} {t}" for c, t in docs.select("doc_id", "text", *columns).dtypes)
        docs = docs.unionByName(spark.createDataFrame(rows, kinds))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = cut(stage(spark, docs, SF_DIR), "odd")
        if number < 4:
            assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        assert (after.count() == 0) == empty
        docs = after


def test_workers_give_memory_back(spark):
    """What a stage took and freed is no part of its worker when the next one begins."""
    import pyarrow as pa

    from podium.llm.common import prepare, tidy

    def fill(batches):
        for batch in batches:
            # small pieces, the last one of which keeps the top of the heap
            held = [bytes(60_000) for _ in range(4_000)]
            kept.append(bytes(60_000))
            del held
            yield batch

    def size(batches):
        import re

        for _ in batches:
            text = open("/proc/self/smaps_rollup").read()
            yield pa.RecordBatch.from_arrays([pa.array([int(re.search(r"\nAnonymous:\s+(\d+)", text)[1]) // 1024])], names=["mb"])

    def grown(run):
        list(run(iter([1])))
        return next(size(iter([1]))).column(0)[0].as_py()

    kept = []
    prepare(spark)
    before = grown(lambda batches: batches)
    assert grown(tidy(fill)) - before < 60
