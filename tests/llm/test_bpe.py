from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from podium.llm import bpe
from podium.llm.queries import vocabulary


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(vocabulary())


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=vocabulary().pattern, mergeable_ranks=coder.ranks, special_tokens={})


def cases():
    rnd = random.Random(3)
    yield from ["", " ", "a", "it's 12,345.6 é 日本語 \n\n  x", "a" * 30_000, "ab" * 2_000, "1" * 2_000, " " * 3_000 + "x", "\0\x7f"]
    for _ in range(40):
        letters = "".join(rnd.sample("etaoinshrdlué", rnd.randint(1, 6)))
        yield "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 400)))
    yield "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(2_000))


def test_ids_are_the_librarys(coder, library):
    texts = list(cases())
    got = coder.encode(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert coder.decode(got) == [t.encode() for t in texts]


def test_unknown_id(coder):
    with pytest.raises(ValueError):
        coder.decode([np.array([60_000], np.int32)])


def test_query_columns(docs_of, library):
    texts = [None, "", "the same", "the same", "x " * 50_000]
    got = bpe.digests(docs_of(texts), vocabulary()).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        ids = library.encode_ordinary(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs_of([]), vocabulary()).count() == 0


def test_encode_then_decode(docs_of):
    texts = ["one two", None, "né"]
    back = bpe.decode(bpe.encode(docs_of(texts), vocabulary()), vocabulary()).orderBy("doc_id").collect()
    assert [bytes(r["bytes"]) for r in back] == [(t or "").encode() for t in texts]


def test_what_a_worker_holds_goes_after_its_last_use(monkeypatch):
    import time

    from podium.llm import common

    monkeypatch.setattr(common, "KEEP_S", 0.2)
    made = []
    held = common.Held(lambda key: made.append(key) or [key])
    first = held.take("a")
    held.give_back("a")
    assert held.take("a") is first  # in time: kept on
    time.sleep(0.4)
    assert held.take("a") is first  # in use: stays
    held.give_back("a")
    time.sleep(0.4)
    assert held.take("a") is not first and made == ["a", "a"]


def test_words_stay_known_between_many_others(monkeypatch):
    own = bpe.Coder(vocabulary())
    solved = []
    monkeypatch.setattr(own, "solve", lambda words, sql: solved.extend(words) or [b""] * len(words))
    few = {f"qzx{k}q" for k in range(100)}
    for words in (few, {f"zq{k}x" for k in range(160_000)}, {f"xq{k}z" for k in range(160_000)}):
        own.learn(words)
    solved.clear()
    own.learn(few)
    assert not solved
