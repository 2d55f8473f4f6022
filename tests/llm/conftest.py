from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of texts, or of (doc_id, text), with columns whose names the operators use inside."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        full = [(i, t, None, "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("fp", "node", "label", "did", "th", "score", "key", "first", "spans", "kept_id", "rows"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def prose():
    rnd = random.Random(7)
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st".split()
    return lambda n: " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))
