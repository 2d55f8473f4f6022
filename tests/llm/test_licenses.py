from __future__ import annotations

import re

import pytest

from podium.llm import licenses


def brute(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    places = []
    for phrase, label in licenses.BASE.items():
        want = phrase.encode().split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(want)] == want]
    at = sorted(k for k, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({label for _, label in places}))


TEXTS = [
    None, "", "MIT License", "the mit-license, MIT LICENSE mit license", "Apache License Version 2.0 or General Public\nLicense",
    "xmit license", "mit licenses", "mité license MIT\tlicense", "mit license " * 20_000, "É mit_license", "lesser general public license",
]


def test_base_against_brute_force(docs_of):
    rows = licenses.scan_licenses(docs_of(TEXTS)).orderBy("doc_id").collect()
    for row, text in zip(rows, TEXTS, strict=True):
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute(text), text
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(row["labels"])


@pytest.mark.parametrize(
    ("expression", "level", "names"),
    [
        ("MIT", 1, ["mit"]),
        ("GPL-2.0-only OR MIT", 1, ["gpl-2.0-only", "mit"]),
        ("GPL-3.0 AND (MIT OR Apache-2.0)", 3, ["apache-2.0", "gpl-3.0", "mit"]),
        ("MIT OR GPL-2.0 AND AGPL-3.0", 1, ["agpl-3.0", "gpl-2.0", "mit"]),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", 2, ["gpl-2.0-or-later"]),
    ],
)
def test_expressions(expression, level, names):
    assert licenses.evaluate(expression) == (level, names)


@pytest.mark.parametrize("broken", ["", "MIT OR", "(MIT", "MIT)", "MIT MIT", "AND MIT", "MIT (BSD)"])
def test_broken_expressions(broken):
    with pytest.raises(ValueError):
        licenses.evaluate(broken)


def test_tag_lines(docs_of):
    text = "// SPDX-License-Identifier: (MIT OR GPL-2.0) this is prose\nmore"
    row = licenses.scan_licenses(docs_of([text, "SPDX-License-Identifier: ???"])).orderBy("doc_id").collect()
    assert row[0]["labels"] == "spdx:gpl-2.0,spdx:mit" and row[0]["n_base"] == 0
    assert row[1]["labels"] == ""
    assert licenses.scan_licenses(docs_of([])).count() == 0
