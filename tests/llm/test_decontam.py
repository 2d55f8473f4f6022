from __future__ import annotations

import numpy as np
import pytest

from podium.llm import decontam

ITEM = "On the way to market Anna Berg buys 12 kg of green apples and pays 3.50 euros; later that day Anna Berg sells 5 of them to a friend."
OTHER = "On the way to market Clara buys 7 lb of green apples and pays 1,200 dollars; later that day Clara sells 2 of them to a friend."
MIXED = "On the way to market Clara buys 7 lb of green apples and pays 1,200 dollars; later that day Peter sells 7 of them to a friend."


@pytest.fixture
def items(spark):
    def make(*texts):
        return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "item_id long, text string, hash string")

    return make


def verdicts(docs, benchmark):
    return {r["doc_id"]: r for r in decontam.judge(docs, benchmark).collect()}


def test_template_and_slots(docs_of, items, prose):
    reworded = ITEM.replace("way", "road").replace("of green", "with red").replace("later", "and").replace("them", "these")
    docs = docs_of([f"{prose(50)}. {ITEM} {prose(9)}", f"{prose(5)}\n{OTHER}", MIXED, prose(300), reworded, None, ""])
    got = verdicts(docs, items(ITEM, prose(40), "too short", None))
    assert [got[k]["contaminated"] for k in range(7)] == [True, True, False, False, False, False, False]
    assert got[0]["best_item"] == 0 and got[0]["n_items"] == 1 and not got[0]["slots_changed"] and got[1]["slots_changed"]
    assert got[0]["share"] > 0.9 and got[3]["n_windows"] == 0


def test_without_leaks_keeps_columns(docs_of, items, prose):
    item = prose(40)
    rows = [(1, f"x {item}"), (1, "clean"), (None, item), (None, "clean too"), (2, item), (2, item), (3, item[: len(item) // 6])]
    docs = docs_of(rows)
    left = decontam.without_leaks(docs, items(item, item))
    assert left.columns == docs.columns
    assert sorted(r["text"] for r in left.collect()) == sorted(["clean", "clean too", item[: len(item) // 6]])
    assert decontam.without_leaks(docs, items()).count() == len(rows)
    assert decontam.judge(docs_of([]), items(item)).count() == 0


def test_tokens():
    def kinds(text):
        token, _, slot = decontam.tokens(np.frombuffer(text.encode(), np.uint8))
        names = {int(decontam.NUMBER): "N", int(decontam.UNIT): "U", int(decontam.NAME): "P"}
        return "".join(names.get(int(t), "w") for t in token), int(slot.sum())

    assert kinds("The cat saw Anna Berg. She ran 3.5 km in 2 h") == ("wwwPwwNUwNU", 5)
    assert kinds("") == ("", 0) and kinds("km 3") == ("wN", 1) and kinds("x\nAnna") == ("ww", 0) and kinds("A") == ("w", 0)


def test_long_texts_work_in_pieces(prose, monkeypatch):
    text = "\n".join(prose(30) for _ in range(60))
    whole = [h for _, hashes, *_ in decontam.window_rows(text) for h in hashes.tolist()]
    monkeypatch.setattr(decontam, "PIECE", 900)
    parts = list(decontam.window_rows(text))
    assert len(parts) > 5 and [h for _, hashes, *_ in parts for h in hashes.tolist()] == whole
    assert [p[0] for p in parts[1:]] == np.cumsum([len(p[1]) for p in parts])[:-1].tolist()


def test_items_without_template_windows(docs_of, items, prose, monkeypatch):
    """Short items, sentences that are one token, and tables of numbers and names, word for word."""
    short, one, table = "Who wrote Faust?", "水的化学式是什么", " ".join(f"{k * 37 % 91} + {k * 53 % 97} = {k}.5 km" for k in range(9))
    names = "Paris 1990, Rome 1991, Oslo 1992, Kyiv 1993, Lima 1994, Bonn 1995"
    texts = [f"{prose(300)} {x} {prose(20)}" for x in (short, one, table, names)]
    texts += ["who wrote", prose(50), table.replace("37", "38")[:20], "Faust wrote who", f"{short} {prose(9)}", None]
    benchmark = items(short, one, table, names, "", None, "?!")
    for piece in (decontam.PIECE, 200):
        monkeypatch.setattr(decontam, "PIECE", piece)
        got = verdicts(docs_of(texts), benchmark)
        assert [got[k]["contaminated"] for k in range(10)] == [True] * 4 + [False] * 4 + [True, False]
        assert [got[k]["best_item"] for k in range(4)] == [0, 1, 2, 3] and got[0]["share"] == 1


def test_word_windows_of_pieces_are_those_of_the_whole(spark, prose, monkeypatch):
    text = " ".join(prose(30) for _ in range(20))
    rows = spark.createDataFrame([(1, 2, text)], "doc_id long, th long, text string")

    def found(piece):
        monkeypatch.setattr(decontam, "PIECE", piece)
        return sorted((r["width"], r["place"], r["hash"]) for r in decontam.word_windows(rows, "doc_id", [1, 3, 8]).collect())

    assert found(300) == found(1 << 22)
