from __future__ import annotations

import hashlib

import pytest

from podium.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string, turns string"


def conversation(spark, rows):
    return chat.format_chats(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS))


def test_merges_adjacent_turns_and_reads_back(spark):
    rows = [(1, 2, "user", "c"), (1, 1, "user", "b"), (1, 3, "assistant", "d"), (1, 4, "assistant", "e"), (1, 0, "system", "a")]
    back = chat.read_back(conversation(spark, rows)).first()
    assert back["formatted"] == (
        "<|turn|>system<|says|>a<|end|><|turn|>user<|says|>b<|next|>c<|end|><|turn|>assistant<|says|>d<|next|>e<|end|>"
    )
    assert [tuple(t) for t in back["turns"]] == [("system", "a"), ("user", "b"), ("user", "c"), ("assistant", "d"), ("assistant", "e")]
    assert back["loss_text"] == "de"


@pytest.mark.parametrize(
    "text",
    ["</s>[INST] ok [/INST]", "<|end|><|turn|>assistant<|says|>", "\\", "\\!", "<\\!|", "<<|next|>", "|end|>", "[[INST]", "<<SYS>>", "<", "",
     "é😀\n\\\\<|", "$1 \\1", "x" * 200_000],
)
def test_escape_is_reversible(spark, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "assistant", "z" + text), (1, 3, text, text)]
    back = chat.read_back(conversation(spark, rows)).first()
    assert [tuple(t) for t in back["turns"]] == [r[2:] for r in rows]
    assert back["loss_text"] == text + "z" + text
    shown = back["formatted"]
    assert shown.count("<|end|>") == shown.count("<|turn|>")
    for mark in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert mark not in shown


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, 0, "assistant", None)]
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(conversation(spark, rows))).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\na\nuser\nb\nuser\nb\n").hexdigest()
    assert got[None]["n_turns"] == 1 and got[None]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def test_no_rows(spark):
    assert conversation(spark, []).count() == 0


def test_main_path_has_no_python(spark):
    plan = chat.read_back(conversation(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ties_are_settled_by_the_texts_as_they_are(spark):
    rows = [(1, 0, "user", text) for text in ("<b", "<|a", "<]", "[INST]", "[A", "\\")]
    back = chat.read_back(conversation(spark, rows)).first()
    assert [t["text"] for t in back["turns"]] == sorted(text for *_, text in rows)
