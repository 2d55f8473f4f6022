from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from podium.llm import alignment, queries

OF = queries.tokenizers()


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(OF)


def brute(texts):
    """Every column by plain loops over A's file and B's model themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = alignment.byte_of_character()
    out, links = [], []
    for text in texts:
        data = f" {text}".encode()
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids_a]
        pieces = [b.id_to_piece(k) for k in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids_b, pieces, strict=True)]
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a = [sum(map(len, bytes_a[: k + 1])) for k in range(len(ids_a))]
        ends_b = [sum(map(len, bytes_b[: k + 1])) for k in range(len(ids_b))]
        groups, i, j, own = [], 0, 0, []
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        for x, end in zip(ids_a, ends_a, strict=True):
            own += [(x, y) for y, other in zip(ids_b, ends_b, strict=True) if end == other]
        out.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    counts = Counter(pair for own in links for pair in own)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (*row, len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own))
        for row, own in zip(out, links, strict=True)
    ]


TEXTS = [
    None, "", " ", "a", "  two  spaces ", "\n\ttabs\r\n", "Das Straßenfest für alle 2024!", "naïve café señor œuvre", "日本語のテキスト", "😀👍🏽",
    "<|endoftext|> <s> </s> <unk> <0x41>", "has ▁ inside", "ﬁne ① ½  nbsp", "don't we'll I'd they're", "\0nul", "x" * 3_000,
    "ab͸cd \U0001e900 ١٢٣", "snake_case camelCase HTTPServer 0xDEADBEEF 3.14159", "the same text", "the same text",
]
COLUMNS = "n_a n_b n_groups groups_sha256 n_links n_best count_sum".split()


@pytest.mark.parametrize("part", [alignment.PART, 40])
def test_against_brute_force(docs_of, prose, part):
    texts = [*TEXTS, prose(400), prose(1_500)]
    rows = alignment.digests(docs_of(texts), OF, part).orderBy("doc_id").collect()
    for row, want, text in zip(rows, brute(texts), texts, strict=True):
        assert tuple(row[c] for c in COLUMNS) == want, text
        # two divisions of one range overlap in so many pairs
        assert row["n_overlaps"] == row["n_a"] + row["n_b"] - row["n_groups"]
    assert sum(row["n_a"] > 0 for row in rows) > 14


def test_overlap_ranges(both):
    found = both.align("Unverständlichkeiten, HTTPServers and 1234567 x")
    ends = [np.cumsum(size[ids]) for size, ids in ((both.size_a, found.a), (both.size_b, found.b))]
    driver, other = sorted(ends, key=len) if len(ends[0]) != len(ends[1]) else ends
    spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in (driver, other)]
    for (x, y), first, last in zip(spans[0], found.first, found.last, strict=True):
        assert [k for k, (p, q) in enumerate(spans[1]) if p < y and q > x] == list(range(first, last + 1))


@pytest.mark.parametrize(("n", "m"), [(1, 1), (5, 3_000), (3_000, 5), (2_000, 2_500), (1, 9_000)])
def test_galloping_ranks(n, m):
    rnd = np.random.default_rng(n + m)
    a, b = (np.unique(rnd.integers(0, 10_000, k)) for k in (n, m))
    assert (alignment.ranks_in(a, b) == np.searchsorted(b, a)).all()
    at_a, at_b, *_ = alignment.intersect(a, b)
    assert (a[at_a] == np.intersect1d(a, b)).all() and (b[at_b] == a[at_a]).all()


def test_rank_file_gives_the_ids_of_the_file_itself(both, prose):
    """For every code point of plain texts, before, after and between letters, digits, marks and spaces."""
    for c in range(0x250):
        for text in (f" {chr(c)}", f" a{chr(c)}b 1{chr(c)}2  {chr(c)}{chr(c)} .{chr(c)}!"):
            assert alignment.PLAIN.fullmatch(text)
            assert both.fast(text) == both.slow.encode(text, add_special_tokens=False).ids, hex(c)
    text = prose(20_000)
    assert both.fast(text) == both.slow.encode(text, add_special_tokens=False).ids


def test_tokens_and_groups_spell_the_texts(spark, docs_of, both):
    texts = ["Ein Beispiel – mit Gedankenstrich", None, "plain words here"]
    for row, text in zip(alignment.align(docs_of(texts), OF).orderBy("doc_id").collect(), texts, strict=True):
        assert b"".join(both.bytes_a[k] for k in row["a"]) == (f" {text}".encode() if text else b"")
        assert b"".join(both.bytes_b[k] for k in row["b"]) == (f" {text}".encode() if text else b"")
        assert len(row["at_a"]) == len(row["at_b"])


def test_repeated_rows_rows_without_id_and_empty_table(docs_of):
    rows = alignment.digests(docs_of([(1, "one text"), (1, "one text"), (None, "one text")]), OF).collect()
    assert len(rows) == 3 and all(row["count_sum"] == 3 * row["n_links"] for row in rows)
    assert alignment.digests(docs_of([]), OF).count() == 0
