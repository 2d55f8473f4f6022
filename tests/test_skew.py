"""Hot groups: the split paths must give what a plain computation gives."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from podium.operators import boards, history, loads, ranking, rescore


def skewed(spark, n=6000, seed=3):
    rnd = random.Random(seed)
    rows = [(0 if rnd.random() < 0.4 else rnd.randint(1, 300), rnd.randint(0, 60), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g long, v long, id long").repartition(8)


def expected_ranks(rows, descending):
    out, by = {}, {}
    for g, v, i in rows:
        by.setdefault(g, []).append((-v if descending else v, i))
    for g, members in by.items():
        for k, (_, i) in enumerate(sorted(members), 1):
            out[i] = k
    return out


def test_hot_groups_are_found(spark):
    _, df = skewed(spark)
    hot = ranking.hot_groups(df, ["g"], 1000)
    assert hot == [df.where("g = 0").select(F.xxhash64("g").alias("h")).first()["h"]]
    assert ranking.hot_groups(df, ["g"], 10_000) == []


def test_rank_of_hot_groups(spark):
    rows, df = skewed(spark)
    for descending in (False, True):
        got = ranking.rank_within(df, ["g"], "v", [F.col("id")], descending=descending, hot_rows=1000)
        assert "_range" in got._jdf.queryExecution().toString()
        assert got.columns == ["g", "v", "id", "rank"]
        assert {r["id"]: r["rank"] for r in got.collect()} == expected_ranks(rows, descending)


def test_rank_of_a_hot_group_of_ties(spark):
    rows = [(0 if i % 3 else i, 7, i * 7919 % 5003) for i in range(5000)]
    df = spark.createDataFrame(rows, "g long, v long, id long").repartition(8)
    got = ranking.rank_within(df, ["g"], "v", [F.col("id")], hot_rows=500)
    assert {r["id"]: r["rank"] for r in got.collect()} == expected_ranks(rows, False)
    hot = ranking.hot_groups(df, ["g"], 500)
    keyed = df.withColumn("_h", F.xxhash64("g"))
    cuts = ranking._cuts(keyed, spark.createDataFrame([(h,) for h in hot], "_h long"), F.struct(F.col("v").alias("k0"), F.col("id").alias("k1")), 500)
    assert [len(r["_cuts"]) for r in cuts.collect()] == [6]


def test_rank_without_hot_groups_is_one_window(spark):
    rows, df = skewed(spark)
    got = ranking.rank_within(df, ["g"], "v", [F.col("id")], hot_rows=10**6)
    assert "_range" not in got._jdf.queryExecution().toString()
    assert {r["id"]: r["rank"] for r in got.collect()} == expected_ranks(rows, False)


def test_rank_finds_hot_on_other_columns(spark):
    rows, df = skewed(spark)
    hot = ranking.hot_groups(df, ["g"], 1000)
    split = df.withColumn("half", F.col("id") % 2)
    got = ranking.rank_within(split, ["g", "half"], "v", [F.col("id")], hot=hot, hot_on=["g"])
    want = {}
    for half in (0, 1):
        want |= expected_ranks([r for r in rows if r[2] % 2 == half], False)
    assert {r["id"]: r["rank"] for r in got.collect()} == want


def test_keep_first_and_last(spark):
    rows, df = skewed(spark)
    first = {r["g"]: r["id"] for r in ranking.keep_first(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    last = {r["g"]: r["id"] for r in ranking.keep_last(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    for g in {r[0] for r in rows}:
        members = sorted((v, i) for h, v, i in rows if h == g)
        assert (first[g], last[g]) == (members[0][1], members[-1][1])


def test_documents_are_cut_but_whole(spark):
    rows, df = skewed(spark)
    numbered = ranking.rank_within(df, ["g"], "v", [F.col("id")], out="place", hot_rows=1000)
    docs = loads.in_documents(numbered, ["g"], "place", 100, "entries").collect()
    assert max(len(d["entries"]) for d in docs) == 100
    places = sorted((d["g"], e["place"], e["id"]) for d in docs for e in d["entries"])
    want = expected_ranks(rows, False)
    assert places == sorted((g, want[i], i) for g, _, i in rows)


def test_upper_median(spark):
    rows, df = skewed(spark)
    got = {r["g"]: r["median"] for r in boards.upper_median(df, ["g"], "v").collect()}
    for g in {r[0] for r in rows}:
        values = sorted(v for h, v, _ in rows if h == g)
        assert got[g] == values[len(values) // 2]


def test_longest_run(spark):
    seen = [(1, p) for p in (1, 2, 3, 7, 8, 9)] + [(2, p) for p in (1, 2)] + [(3, p) for p in (4, 5, 6, 7)]
    got = boards.longest_run(spark.createDataFrame(seen, "entity_id long, period int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, 1, 3), (3, 4, 4, 7)]


def test_head_to_head_counts_shared_contests(spark):
    rnd = random.Random(5)
    ranks = {(c, e): rnd.randint(1, 9) for c in range(200) for e in range(6) if rnd.random() < 0.6}
    best = spark.createDataFrame([(c, e, 2000 + c % 2, r) for (c, e), r in ranks.items()], "contest_id long, entity_id long, period int, rank int")
    pairs = spark.createDataFrame([(1, 0, 1), (2, 1, 2)], "pair_id int, a_id long, b_id long")
    for r in history.head_to_head(best, pairs).collect():
        shared = [c for c in range(200) if 2000 + c % 2 == r["period"] and (c, r["a_id"]) in ranks and (c, r["b_id"]) in ranks]
        assert r["shared"] == len(shared)
        assert r["a_wins"] == sum(ranks[c, r["a_id"]] < ranks[c, r["b_id"]] for c in shared)
        assert r["ties"] == sum(ranks[c, r["a_id"]] == ranks[c, r["b_id"]] for c in shared)


def test_rescored_hot_contest(spark):
    rnd = random.Random(9)
    rows = [(0 if i % 3 else i, i, 1, i % 50 + 1, rnd.randint(1000, 5000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "contest_id long, boat_id long, line_no int, rank int, corrected long")
    hot = ranking.hot_groups(df, ["contest_id"], 500)
    assert len(hot) == 1
    split = {r["boat_id"]: (r["new_rank"], r["old_rank"]) for r in rescore.both_ranks(df, hot=hot).collect()}
    plain = {r["boat_id"]: (r["new_rank"], r["old_rank"]) for r in rescore.both_ranks(df, hot=[]).collect()}
    assert split == plain


def test_spearman_and_scores(spark):
    ranked = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 3), (2, 1, 1)], "contest_id long, old_rank int, new_rank int")
    got = rescore.rank_agreement(ranked, ["contest_id"]).collect()
    assert [(r["contest_id"], r["n"], r["rho"]) for r in got] == [(1, 3, 0.5)]
