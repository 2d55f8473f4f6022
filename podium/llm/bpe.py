"""Operator 3, byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

Encoding. The pattern splits a whole text into words. A word that is a token itself is that token. The others start as
lists of byte tokens; in a recursive query their token-position rows join the merge table, and each word contracts its
leftmost pair of least rank until no pair is left. Words repeat, so each distinct word is solved once and kept in a cache
of bounded size. Long words contract several pairs in one step, where that comes to the same as one after the other.

Decoding. The ids join the vocabulary, and an ordered aggregation concatenates their bytes by position.

A null text counts as empty: no ids. Empty tables give no rows; repeated rows have equal results; ties in rank go to the
leftmost place. Rows without doc_id are encoded as others are. Extra columns are not read. An id outside the vocabulary is
an error. The vocabulary file is read on the driver and travels with the code (its size is checked).
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import Held, prepare

#: A vocabulary file above this is not sent along.
MAX_VOCABULARY = 64 << 20
#: Distinct words kept in a cache's younger half; when it is full, it becomes the older half, which is dropped.
CACHE = 300_000
#: Ids of one text that are decoded as one stretch.
STRETCH = 4_096
#: Words solved by one recursive query, and the bytes from which a word is long.
TOGETHER, LONG = 20_000, 32
#: Characters of text encoded together.
PART = 2 << 20

SHORT_WORDS = """
WITH RECURSIVE step(w, toks) AS (
    SELECT w, toks FROM words
    UNION ALL
    SELECT s.w, list_concat(s.toks[: (b.best & 65535) - 1], [(b.best >> 16)::INT], s.toks[(b.best & 65535) + 2 :])
    FROM step s JOIN (
        SELECT p.w, min(m.rank::BIGINT << 16 | p.i) AS best
        FROM (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(1, len(toks))) AS i FROM step) p
        JOIN merges m ON m.pair = (p.l::BIGINT << 20 | p.r)
        GROUP BY p.w
    ) b ON b.w = s.w
)
SELECT w, arg_min(toks, len(toks)) AS ids FROM step GROUP BY w
"""

# {reach}: bytes of the longest token. A pair of least rank within that many places on either side can't be touched by
# what happens further away, so all such pairs contract in one step, the leftmost of equal ones first. So do all places
# of the word's least pair, up to the first whose new token joins a neighbour at a lower rank (table onward).
LONG_WORDS = """
WITH RECURSIVE step(w, toks) USING KEY (w) AS (
    SELECT w, toks FROM words
    UNION ALL (
        WITH pairs AS (
            SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(1, len(toks))) AS i,
                unnest(list_concat([1048575], toks[:-3])) AS before, unnest(list_concat(toks[3:], [1048575])) AS behind
            FROM step
        ), ranked AS (
            SELECT p.w, p.i, p.before, p.behind, m.rank
            FROM pairs p JOIN merges m ON m.pair = (p.l::BIGINT << 20 | p.r)
        ), placed AS (
            SELECT w, i, rank, before, behind, min(rank) OVER (PARTITION BY w) AS least,
                min(rank) OVER (PARTITION BY w ORDER BY i RANGE BETWEEN {reach} PRECEDING AND 1 PRECEDING) AS least_before,
                min(rank) OVER (PARTITION BY w ORDER BY i RANGE BETWEEN 1 FOLLOWING AND {reach} FOLLOWING) AS least_behind
            FROM ranked
        ), hits AS (
            SELECT w, i, rank, i - row_number() OVER (PARTITION BY w ORDER BY i) AS island,
                (rank << 20 | behind) IN (SELECT pair FROM onward) OR (before << 20 | rank) IN (SELECT pair FROM onward)
                    OR (rank << 20 | rank) IN (SELECT pair FROM onward) AS unsafe
            FROM (SELECT w, i, rank::BIGINT AS rank, before::BIGINT AS before, behind::BIGINT AS behind FROM placed WHERE rank = least)
        ), apart AS (
            SELECT w, i, rank, (i - min(i) OVER (PARTITION BY w, island)) % 2 AS odd,
                min(CASE WHEN unsafe THEN i END) OVER (PARTITION BY w) AS stop
            FROM hits
        ), chosen AS (
            SELECT w, i, rank FROM apart WHERE odd = 0 AND i < coalesce(stop, i + 1)
            UNION
            SELECT w, i, rank FROM placed
            WHERE rank < coalesce(least_before, rank + 1) AND rank <= coalesce(least_behind, rank)
        )
        SELECT t.w, list(coalesce(c.rank, t.tok)::INT ORDER BY t.i)
        FROM (SELECT w, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM step) t
        LEFT JOIN chosen c ON c.w = t.w AND c.i = t.i
        LEFT JOIN chosen d ON d.w = t.w AND d.i = t.i - 1
        WHERE d.i IS NULL AND t.w IN (SELECT w FROM chosen)
        GROUP BY t.w
    )
)
SELECT w, toks AS ids FROM step
"""

# Ids come in stretches of one text, so that an aggregate's state is bounded.
DECODED = """
SELECT stretch, array_to_string(list(token ORDER BY pos), '') AS bytes
FROM ids JOIN vocabulary USING (id) GROUP BY stretch ORDER BY stretch
"""


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line)}


@dataclass(frozen=True)
class Vocabulary:
    """The lines of a rank file and the pattern that splits texts; small enough to travel with the code."""

    blob: bytes
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            blob = file.read(MAX_VOCABULARY + 1)
        if len(blob) > MAX_VOCABULARY:
            raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
        return cls(blob, pattern)


class Coder:
    """Encodes and decodes by queries of one DuckDB connection; holds nothing but bounded caches between batches."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb
        import regex

        self.split = regex.compile(vocabulary.pattern).findall
        self.ranks = read_ranks(vocabulary.blob)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        self.load_merges()
        self.long_words = LONG_WORDS.format(reach=max(map(len, self.ranks)))
        size = max(self.ranks.values()) + 1
        self.known = np.zeros(size, bool)
        self.known[list(self.ranks.values())] = True
        self.decimal = np.char.mod("%d", np.arange(size)).tolist()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def load_merges(self) -> None:
        """Every pair of tokens whose bytes together are a token; those whose token ranks below one of the two."""
        rows = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None
        ]
        left, right, rank = np.array(rows or np.empty((0, 3)), np.int64).T
        pair = left << 20 | right
        self.create("merges", pair=pair, rank=rank.astype(np.int32))
        self.create("onward", pair=pair[rank < np.maximum(left, right)])
        ids = np.array(list(self.ranks.values()), np.int32)
        # a character for each byte
        self.create("vocabulary", id=ids, token=[token.decode("latin-1") for token in self.ranks])

    def create(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def ask(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.con.register(name, table)
        found = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return found

    def solve(self, words: list[bytes], sql: str) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit numbers."""
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        tokens = pa.array(self.bytes[np.frombuffer(b"".join(words), np.uint8)], pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)
        found = self.ask(sql, "words", pa.table({"w": pa.array(range(len(words)), pa.int32()), "toks": lists})).sort_by("w")
        ids = found.column("ids").combine_chunks()
        flat = ids.flatten().to_numpy().astype("<i4").tobytes()
        ends = 4 * ids.offsets.to_numpy()
        ends = ends - ends[0]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def learn(self, words: set[str]) -> None:
        """Bring the ids of new words into the cache."""
        if len(self.words) > CACHE:
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        short, long = [], []
        for w in words.difference(known):
            if (ids := older.get(w)) is not None:
                known[w] = ids
                continue
            data = w.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(data)) is not None:
                known[w] = rank.to_bytes(4, "little")
            else:
                (short if len(data) <= LONG else long).append((w, data))
        for sql, todo, step in ((SHORT_WORDS, short, TOGETHER), (self.long_words, long, 100)):
            for k in range(0, len(todo), step):
                part = todo[k : k + step]
                known.update(zip([w for w, _ in part], self.solve([data for _, data in part], sql), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the distinct words of all of them are solved together."""
        words = [self.split(text) for text in texts]
        self.learn(set(chain.from_iterable(words)))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, w)), "<i4") for w in words]

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids."""
        sizes = np.array([len(ids) for ids in lists])
        ids = np.concatenate([np.empty(0, np.int32), *lists])
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        counts = -(-sizes // STRETCH)
        stretch = np.repeat(np.cumsum(counts) - counts, sizes) + pos // STRETCH
        rows = pa.table({"stretch": stretch.astype(np.int32), "pos": pos.astype(np.int32), "id": ids})
        data = self.ask(DECODED, "ids", rows).column("bytes").to_pylist()
        ends = np.cumsum(counts).tolist()
        return ["".join(data[a:b]).encode("latin-1") for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def listed(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))


#: One for each vocabulary in a Python worker.
CODERS = Held(Coder)


def coder(vocabulary: Vocabulary) -> Coder:
    return CODERS.take(vocabulary)


def let_go(vocabulary: Vocabulary) -> None:
    CODERS.give_back(vocabulary)


def in_parts(texts: list[str | None], most: int = PART):
    """Lists of texts of about ``most`` characters together; a longer text is a list of its own."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    prepare(docs.sparkSession)

    def run(batches):
        of = coder(vocabulary)
        for batch in batches:
            at = 0
            for part in in_parts(batch.column(1).to_pylist()):
                ids = pa.array(of.encode(part), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), ids], names=["doc_id", "ids"])
                at += len(part)
        let_go(vocabulary)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids); null ids count as none."""
    prepare(encoded.sparkSession)

    def run(batches):
        of = coder(vocabulary)
        for batch in batches:
            found = of.decode([np.array(ids or [], np.int32) for ids in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "bytes"])
        let_go(vocabulary)

    own = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return own.mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary: Vocabulary, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for.

    Each text is encoded, and its ids are decoded again.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        of = coder(vocabulary)
        for batch in batches:
            at = 0
            for part in in_parts(batch.column(1).to_pylist()):
                ids = of.encode(part)
                columns = [
                    batch.column(0).slice(at, len(part)),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(of.listed(i).encode()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(data).hexdigest() for data in of.decode(ids)]),
                    *[pa.array(ids, pa.list_(pa.int32()))] * with_ids,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(part)
        let_go(vocabulary)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return own.mapInArrow(run, schema)
