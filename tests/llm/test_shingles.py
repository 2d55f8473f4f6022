from __future__ import annotations

import random

from podium.llm import shingles, simhash


def words_of(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """Smallest index reachable over pairs with at least 0.8 of their shingles in common."""
    sets = [words_of(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


def edited(text, rnd, n):
    words = text.split()
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.random()}"
    return " ".join(words)


def test_near_copies_against_brute_force(docs_of, prose):
    rnd = random.Random(1)
    texts = [None, "", " \t", "two words", "Two  WORDS", "a b c d e " * 40, "a b c d e"]
    for k in range(30):
        base = prose(300)
        texts += [base, edited(base, rnd, k % 9), base.upper()]
    # a group in which only some pairs are near, and texts that share a long line
    base, line = prose(120), prose(60)
    texts += [edited(base, rnd, 2) for _ in range(80)] + [f"{prose(40)} {line}" for _ in range(60)]
    want = groups(texts)
    assert 0 < sum((simhash.fingerprint(a or "", 5) ^ simhash.fingerprint(b or "", 5)).bit_count() > simhash.MAX_BITS
                   for a, b, x, y in zip(texts, texts[1:], want, want[1:], strict=False) if x == y)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(texts), 5, (4, 5)).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs_of(texts)).collect()) == sorted(set(want))


def test_long_texts_work_in_pieces(prose, monkeypatch):
    text = prose(900)
    whole = shingles.shingle_set(text, 5)
    assert len(whole) == len(words_of(text))
    monkeypatch.setattr(shingles, "CHUNK", 100)
    assert (shingles.shingle_set(text, 5) == whole).all()


def test_rows_without_id_and_repeated_ids(docs_of, prose):
    text, other = prose(100), prose(100)
    rows = [(None, text), (None, text + " end"), (4, text), (4, other), (9, other + " end"), (2, None), (3, "")]
    got = simhash.near_duplicates(docs_of(rows), 5, (4, 5)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == sorted(
        [("None", 4), ("None", 4), ("4", 4), ("4", 4), ("9", 4), ("2", 2), ("3", 2)]
    )
    assert simhash.near_duplicates(docs_of([]), 5, (4, 5)).count() == 0
    only = [(None, text), (None, text + " end")]
    assert [r["component_id"] for r in simhash.near_duplicates(docs_of(only), 5, (4, 5)).collect()] == [None, None]


def test_golay_keys_give_candidates(docs_of, prose, caplog):
    caplog.set_level("INFO")
    text = prose(900)
    simhash.near_duplicates(docs_of([text, text + " end", edited(text, random.Random(3), 15)]), 5, (4, 5)).collect()
    found = [r.getMessage() for r in caplog.records if "Golay" in r.getMessage()]
    assert found == ["links from Golay keys: 1, from bands besides: 1"]


def family(rnd, words, n, edits):
    """Copies of one text with ``edits`` words changed, the text itself not among them."""
    base = " ".join(f"w{rnd.random()}" for _ in range(words))
    return [edited(base, rnd, edits) for _ in range(n)]


def pairs_compared(monkeypatch):
    """Numbers of candidate pairs whose sets are fetched, by round."""
    seen, similar = [], shingles.similar

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(shingles, "similar", counted)
    return seen


def test_family_below_the_similarity_is_not_compared_in_pairs(docs_of, monkeypatch):
    # 0.73 in common on average: most bands meet, nothing links
    texts = family(random.Random(5), 400, 120, 13)
    seen = pairs_compared(monkeypatch)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(texts), 5, (4, 5)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(texts)
    assert len(seen) == 4 and seen[-1] < len(texts)


def test_families_around_the_similarity_against_brute_force(docs_of):
    rnd = random.Random(6)
    texts = [t for edits in (6, 8, 9, 10, 11) for t in family(rnd, 400, 30, edits)]
    # families whose members stand with a copy of their own, of which one reaches another family's half
    texts += [f"{t} {end}" for t in family(rnd, 200, 25, 6) for end in ("", "one more")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(texts), 5, (4, 5)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(texts)


def test_marks_and_shared_shingles_are_bounds(spark, monkeypatch):
    rnd = random.Random(8)
    base = [rnd.getrandbits(63) for _ in range(300)]
    sets = [sorted(base[: 300 - 9 * k] + [rnd.getrandbits(63) for _ in range(5 * k)]) for k in range(12)]
    rows = [(k, bytearray(shingles.np.array(s, shingles.np.uint64).tobytes())) for k, s in enumerate(sets)]
    whole = spark.createDataFrame(rows, "node long, shingles binary")
    # two buckets, the larger component is 0; 7 and 8 are one component
    of = {7: 7, 8: 7, 0: 0, 1: 0}
    mixed = spark.createDataFrame([(key, k, of.get(k, k), 0) for key in (1, 2) for k in range(12)], "key long, node long, label long, main long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in shingles.between(mixed, whole, (4, 5)).collect()]
    near = {
        (a, b)
        for b in range(12)
        for a in range(b)
        if of.get(a, a) != of.get(b, b) and 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})
    }
    assert near and near <= set(got) and len(got) == len(set(got)) < 66 / 2
    assert not any(of.get(a, a) == of.get(b, b) for a, b in got)
