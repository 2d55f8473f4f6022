from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from podium.llm import queries, tour, trie

TURNS = "conv_id long, turn long, role string, text string, depth string, v string, n string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TURNS)


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(role, text) for _, _, role, _, text in sorted(said)] for c, said in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        base, h = c - c % 5, zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    def below(node):
        found, todo = [], [node]
        while todo:
            found.append(todo.pop())
            todo.extend(children[found[-1]])
        return found

    rows = set()
    for node, of in members.items():
        tree = below(node)
        ends = sorted(c for c in of if len(convs[c]) == len(node))
        rows.add((
            min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]),
            sum(not children[u] for u in tree), sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in tree if u),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return rows


def random_rows(seed, convs=60):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        if rnd.random() < 0.1:
            continue
        turns = rnd.choice([1, 2, 3, 5, 9, 14])
        rows += [(c, t if t else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "", None, "ccc"])) for t in range(turns)]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "eit"), (7, 3, "user", "tie"), (None, 1, "user", "nobody's")]
    rnd.shuffle(rows)
    return rows


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def as_set(df):
    rows = df.select(COLUMNS).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.mark.parametrize(("seed", "block"), [(1, tour.BLOCK), (2, 16)])
def test_against_brute_force(spark, seed, block):
    rows = random_rows(seed)
    assert as_set(trie.prefix_trie(*trie.rebuilt(turns_of(spark, rows)), block)) == brute(rebuilt(in_order(rows)))


def test_as_they_are_with_long_and_equal_conversations(spark):
    rows = [(c, t, "user", "x" if t < 2_500 else str(c)) for c in (1, 2) for t in range(2_501)]
    rows += [(c, 0, "user", "same") for c in range(10, 5_000, 7)]
    found = as_set(trie.prefix_trie(*trie.as_they_are(turns_of(spark, rows)), 1_000))
    convs = in_order(rows)
    # brute force of the deep path is quadratic: its nodes are known in closed form
    same = sorted(c for c in convs if c >= 10)
    ids = hashlib.sha256(",".join(map(str, same)).encode()).hexdigest()
    assert (10, 1, 1, len(same), 0, 1, 4 * (len(same) - 1), ids) in found
    none = hashlib.sha256(b"").hexdigest()
    assert (1, 0, None, len(convs), 2, 3, 4 * (len(same) - 1) + 2_500, none) in found
    for d in range(1, 2_500):
        assert (1, d, 1, 2, 1, 2, 2_501 - d, none) in found
    assert {r[:5] for r in found if r[1] == 2_501} == {(1, 2_501, 1, 1, 0), (2, 2_501, 1, 1, 0)}
    assert len(found) == 2 + 2_500 + 2


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "gone")]
    assert as_set(trie.prefix_trie(*trie.rebuilt(turns_of(spark, rows)))) == brute(rebuilt(in_order(rows)))
    assert trie.prefix_trie(*trie.rebuilt(turns_of(spark, rows))).count() == 1


def test_empty_table(spark):
    assert trie.prefix_trie(*trie.rebuilt(turns_of(spark, []))).count() == 0
    assert trie.prefix_trie(*trie.rebuilt(turns_of(spark, [(None, 0, "user", "x")]))).count() == 0


@pytest.mark.parametrize("block", [7, 64, 1_000])
def test_list_ranking_of_a_shuffled_list(spark, block):
    order = np.random.default_rng(block).permutation(300).tolist()
    links = [(a, b) for a, b in zip(order, [*order[1:], -1], strict=True)]
    ranks = tour.list_ranks(spark.createDataFrame(links, "id long, follows long"), 300, block).collect()
    assert {r["id"]: r["rank"] for r in ranks} == {a: 300 - k for k, a in enumerate(order)}


def test_prefix_sums_over_several_runs(spark):
    values = np.random.default_rng(3).integers(0, 9, 700).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "place long, value long").repartition(5)
    found = {r["place"]: r["value"] for r in tour.prefix_sums(df, "place", ["value"], bits=3).collect()}
    assert [found[k] for k in range(700)] == np.cumsum(values).tolist()


def test_oracle_says_the_same_of_odd_rows(spark):
    rows = [r for r in random_rows(5) if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.OP12_SQL})").fetchall()
    assert len(found) == len(set(found)) and set(found) == brute(rebuilt(in_order(rows)))
