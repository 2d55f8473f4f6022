from __future__ import annotations

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from podium.llm import golay, simhash
from podium.llm.components import components


def fingerprint(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Smallest index reachable over pairs at four bits or fewer."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= simhash.MAX_BITS and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_golay_code_is_perfect():
    assert len(set(golay.ERROR.tolist())) == 1 << 11
    words = np.random.default_rng(1).integers(0, 1 << 23, 2_000).astype(np.uint32)
    codewords = golay.index(words).astype(np.uint32)
    codewords = codewords << 11 | golay.UPPER[codewords]
    assert max(int(x).bit_count() for x in codewords ^ words) <= 3


def test_near_fingerprints_share_a_key():
    rnd = random.Random(5)
    a = [rnd.getrandbits(64) for _ in range(1_000)]
    b = [x ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for x in a]
    keys = []
    for fps in (a, b):
        at, key = simhash.golay_keys(np.array(fps, np.uint64).view(np.int64))
        found = [set() for _ in fps]
        for i, k in zip(at, key, strict=True):
            found[i].add(int(k))
        keys.append(found)
    assert all(x & y for x, y in zip(*keys, strict=True))


def test_dense_group_against_brute_force(spark):
    rnd = random.Random(9)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = [c ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(60)]
    fps += [rnd.getrandbits(64) for _ in range(200)]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, first long")
    labels = {r["node"]: r["label"] for r in simhash.class_labels(classes).collect()}
    want = groups(fps)
    got = [labels.get(s, s) for s in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("width", [4, 5])
def test_documents(docs_of, prose, width):
    base = prose(400)
    texts = [base, base.upper(), base + " tail", prose(300), None, "", " \t\n", "two words", "TWO  words", prose(3), base, "x" * 300_000]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(texts), width).collect()}
    fps = [fingerprint(t, width) for t in texts]
    assert [got[k]["fp"] % (1 << 64) for k in range(len(texts))] == fps
    assert [got[k]["component_id"] for k in range(len(texts))] == groups(fps)


def test_one_of_each(docs_of, prose):
    base = prose(200)
    docs = docs_of([(5, base), (3, base), (3, base), (9, prose(50)), (None, "alone in this"), (None, base), (7, None)])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(3, base), (9, docs.where("doc_id = 9").first()["text"]), (None, "alone in this"), (None, base), (7, None)], key=str
    )
    assert simhash.one_of_each(docs_of([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(9, 9), (None, 4), (300, 201), (201, 300)]
    labels = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {labels[k] for k in range(100, 161)} == {100} and {labels[k] for k in [1, *range(200, 260), 300]} == {1}
    assert 9 not in labels and 4 not in labels
