"""Operator 13, secret scans by dictionary-primed zstandard novelty.

Base kinds are patterns: values assigned to names such as password, access ids, long hexadecimal runs. The method adds
the kind ``novel``. Candidates are unbroken strings that hold a letter and a digit and follow a sensitive word within
REACH code points. A compressor is primed with a dictionary of identifiers; the marginal bytes of a candidate are what
it adds to the compressed size of its surroundings, from which its own repetitions are taken out. A candidate that adds
at least NOVEL bytes for each of its own can't be put together from identifiers and code around it, and is reported.

The dictionary holds fixed words and the identifiers that stand before an assignment or a call in most documents of the
corpus, counted over all of it; its size is bounded by a parameter.

A null text counts as empty: no spans. Places are code points of the whole text, whatever its length. Overlapping spans
of different kinds all stay, ordered by start, then kind. Repeated rows need no rule, as every row stands for itself; in
the count of documents each counts. Rows without doc_id are scanned as others are. An empty table gives no rows, and the
dictionary of fixed words. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import map_texts

# The patterns of the base kinds, in their order, and the least length of a match (of its group).
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+, of 24 and more; shorter runs need no look
BASE = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24)]
KINDS = {name: k for k, name in enumerate(["assign", "access", "hex", "novel"])}
# Words that make a context sensitive, and words of code and of settings that are known to any reader.
SENSITIVE = re.compile(
    r"pass|pwd|secret|token|key|auth|cred|bearer|private|session|cookie|signature|salt|cert|login", re.IGNORECASE | re.ASCII
)
WORDS = (
    "false true null none self this return import from class def function const let var public static final void string int "
    "float double boolean object array list dict map value values name names index size length count type id uuid version "
    "config configuration settings options default environment production development staging test debug release server "
    "client host hostname port path file directory database username user users account accounts email address connection "
    "timeout request response header headers content application json xml html http https www com org net localhost session "
    "cookie login logout authentication authorization credentials credential certificate signature private public shared "
    "access_key secret_key api_key apikey client_id client_secret access_token refresh_token auth_token token secret password "
    "passwd pwd passphrase encryption decrypt encrypt hash salt bearer oauth manager service provider factory handler builder "
    "example sample placeholder changeme your_api_key_here your_password_here abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890"
)

#: An identifier before an assignment, a colon or a call; made of letters, so that no secret becomes a known word.
IDENTIFIER = r"(?<![A-Za-z0-9_+/=-])[A-Za-z]{2,15}(?:_[A-Za-z]{2,15}){0,3}(?=[\"']? {0,2}[:=(])"
#: Identifiers of the corpus in the dictionary.
LEARNED = 2_000
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
MIXED = re.compile(r"[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]")
#: Code points before a candidate in which a sensitive word counts, and those around it that it is measured against.
REACH, AROUND = 48, 600
#: Least marginal bytes for each byte of a reported candidate.
NOVEL = 0.7
LEVEL = 3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, each leftmost and non-overlapping; matches that are too short are dropped."""
    return [
        (m.start(), m.end(), kind)
        for kind, pattern, group, least in BASE
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]


def identifiers(docs: DataFrame, most: int = LEARNED) -> list[str]:
    """The identifiers that most documents hold, at most ``most``; ties by name."""
    names = F.array_distinct(F.regexp_extract_all(F.col("text").cast("string"), F.lit(IDENTIFIER), F.lit(0)))
    counts = docs.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return [row["name"] for row in counts.orderBy(F.desc("n"), "name").limit(most).collect()]


def dictionary(learned: list[str]) -> bytes:
    """Raw content for the compressor; what stands in most documents comes last, where it is cheapest to refer to."""
    return " ".join([*reversed(learned), *WORDS.split()]).encode()


class Scanner:
    """Finds the spans of one text."""

    def __init__(self, content: bytes):
        import zstandard

        primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        # frames say nothing but their content
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, **plain).compress

    def marginal(self, text: str, start: int, end: int) -> int:
        """Compressed bytes that text[start:end] adds to its surroundings."""
        own = text[start:end]
        around = f"{text[end : end + AROUND]}\n{text[max(0, start - AROUND) : start]}".replace(own, "").encode()
        return len(self.compress(around + own.encode())) - len(self.compress(around))

    def novel_spans(self, text: str) -> list[tuple[int, int, str]]:
        return [
            (start, end, "novel")
            for start, end in (m.span() for m in CANDIDATE.finditer(text))
            if SENSITIVE.search(text, max(0, start - REACH), start)
            and MIXED.search(text, start, end)
            and self.marginal(text, start, end) >= NOVEL * (end - start)
        ]

    def scan(self, text: str):
        base = base_spans(text)
        novel = self.novel_spans(text)
        count = [sum(kind == name for _, _, kind in base) for name, *_ in BASE]
        return *count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + novel), len(novel)


def listed(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind, joined by commas."""
    ordered = sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def scan_secrets(docs: DataFrame, learned: int = LEARNED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel of every whole text."""
    content = dictionary(identifiers(docs, learned))
    return map_texts(
        docs,
        lambda: Scanner(content).scan,
        [
            ("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"),
            ("n_novel", "long"),
        ],
    )
