"""Operator 11, cross-tokenizer alignment by galloping intersection of token ends.

Tokenizer A encodes a space and the text, tokenizer B the text, before which it puts a space itself. Both lists of token
ends are byte offsets of the same bytes. The shorter list drives: doubling steps in the longer list, from where the block
before ended, bound a block of its ends, and a binary search inside that bound places each of them. Common ends cut the
tokens into groups; the ranks of two neighbouring driver ends in the other list bound the tokens that overlap the driver
token between them. A link is a pair of tokens that end together.

Statistics of the corpus. Texts are aligned in blocks of bounded size. A block keeps its different id pairs with their
counts, and its links as numbers of those pairs. Counts are summed over all blocks; every block gets back the count of
each of its pairs, and whether it is the highest of its B id, and sums them over each text's links.

A null or empty text, or one whose tokens of A or of B don't spell the space and the text (B changes some characters),
has no tokens: zeros, and an empty string of groups. Control strings inside texts are plain text. Repeated rows stay and
count once each. Rows without doc_id are aligned as others are. An empty table gives no rows. Extra columns are not
read. A text of any length is one block with itself. The vocabularies are read on the driver, up to a checked size.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.bpe import MAX_VOCABULARY, in_parts
from podium.llm.common import cut, prepare

#: Characters of a block's texts; a longer text is a block of its own.
PART = 2 << 20
#: Driver ends that share their doubling steps.
TOGETHER = 256
#: Bits of an id of B in the number of a pair.
B_BITS = 16
#: Code points on whose classes the libraries agree (tests compare each of them). Texts of these alone are encoded by the
#: rank file, which holds A's own merges and is faster; others by A's file itself.
PLAIN = re.compile("[\0-ɏ]*")


@dataclass(frozen=True)
class Tokenizers:
    """A's file, its merges as ranks with the pattern that splits texts, and B's model; they travel with the code."""

    a: bytes
    ranks: bytes
    pattern: str
    b: bytes

    @classmethod
    def load(cls, a: str, ranks: str, pattern: str, b: str) -> Tokenizers:
        def content(path: str) -> bytes:
            with open(path, "rb") as file:
                blob = file.read(MAX_VOCABULARY + 1)
            if len(blob) > MAX_VOCABULARY:
                raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
            return blob

        return cls(content(a), content(ranks), pattern, content(b))


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself, and the k-th of the others as character 256 + k."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def ranks_in(driver: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many of other are smaller than each of driver; both ascend."""
    found, base, size = np.empty(len(driver), np.int64), 0, len(other)
    for k in range(0, len(driver), TOGETHER):
        x = driver[k : k + TOGETHER]
        # exponential: doubling steps until the block's last end is passed
        bound, step = base, 1
        while bound < size and other[bound] < x[-1]:
            bound += step
            step *= 2
        # binary: every end of the block between where the block before ended and there
        found[k : k + TOGETHER] = base + np.searchsorted(other[base:bound], x)
        base = int(found[k + len(x) - 1])
    return found


def intersect(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the common values in a and in b; of each driver token, the first and last token of the other list that
    it overlaps. The shorter list drives."""
    driver, other = (a, b) if len(a) <= len(b) else (b, a)
    rank = ranks_in(driver, other)
    meets = other[np.minimum(rank, len(other) - 1)] == driver
    at = np.flatnonzero(meets)
    first = np.concatenate([[0], (rank + meets)[:-1]])
    places = (at, rank[at]) if driver is a else (rank[at], at)
    return *places, first, rank


@dataclass(frozen=True)
class Aligned:
    """The tokens of one text, and the places at which common ends stand in either list."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    first: np.ndarray
    last: np.ndarray


NOTHING = Aligned(*[np.empty(0, np.int64)] * 6)


class Aligner:
    """Both tokenizers of a Python worker."""

    def __init__(self, of: Tokenizers):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(of.a.decode())
        self.slow.encode_special_tokens = True
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, of.ranks.splitlines())}
        self.fast = tiktoken.Encoding("a", pat_str=of.pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.model = sentencepiece.SentencePieceProcessor(model_proto=of.b)
        byte = byte_of_character()
        vocabulary = json.loads(of.a)["model"]["vocab"]
        # the control string among A's entries is plain text, and so never one token
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes_a[number] = bytes(byte[c] for c in token)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode()
            for k, piece in enumerate(pieces)
        ]
        if len(self.bytes_b) > 1 << B_BITS:
            raise ValueError(f"B has more than {1 << B_BITS} entries")
        self.size_a, self.size_b = (np.array(list(map(len, table)), np.int64) for table in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.decimal = {mark: np.array([f"{k}{mark}" for k in range(most)], object) for mark in ",|;"}

    def ids_a(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text):
            return self.fast(text)
        return self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def align(self, text: str | None) -> Aligned:
        if not text:
            return NOTHING
        spaced = f" {text}"
        a, b, data = self.ids_a(spaced), self.model.encode(text), spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return NOTHING
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return Aligned(a, b, *intersect(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])))

    def written(self, of: Aligned) -> str:
        """The groups: ids of A, a bar, ids of B, and a semicolon between groups."""
        if not len(of.a):
            return ""
        shown = np.empty(len(of.a) + len(of.b), object)
        for ids, ends, before, mark in ((of.a, of.at_a, np.concatenate([[0], of.at_b[:-1] + 1]), "|"), (of.b, of.at_b, of.at_a + 1, ";")):
            group = np.zeros(len(ids), np.int64)
            group[ends[:-1] + 1] = 1
            words = self.decimal[","][ids]
            words[ends] = self.decimal[mark][ids[ends]]
            shown[np.arange(len(ids)) + before[np.cumsum(group)]] = words
        return "".join(shown.tolist())[:-1]


@functools.lru_cache(maxsize=2)
def aligner(of: Tokenizers) -> Aligner:
    """One for each pair of tokenizers in a Python worker."""
    return Aligner(of)


def align(docs: DataFrame, of: Tokenizers) -> DataFrame:
    """(doc_id, a, b, at_a, at_b): each text's ids, and the places of the last A and B token of each group."""
    prepare(docs.sparkSession)

    def run(batches):
        both = aligner(of)
        for batch in batches:
            ids = batch.column(0)
            for k, text in enumerate(batch.column(1)):
                found = both.align(text.as_py())
                columns = [pa.array([x], pa.list_(pa.int32())) for x in (found.a, found.b, found.at_a, found.at_b)]
                yield pa.RecordBatch.from_arrays([ids.slice(k, 1), *columns], names=["doc_id", "a", "b", "at_a", "at_b"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, a array<int>, b array<int>, at_a array<int>, at_b array<int>")


DOC = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_overlaps": pa.int64(), "groups_sha256": pa.string()}
KINDS = {pa.int64(): "long", pa.string(): "string"}


def blocks(docs: DataFrame, of: Tokenizers, part: int = PART) -> DataFrame:
    """A row for each block: arrays over its texts (doc_id, n_a, n_b, n_groups, n_overlaps, groups_sha256), its different
    pairs and their counts, the most frequent first, and links, the compressed numbers of all links' pairs."""
    prepare(docs.sparkSession)

    def run(batches):
        import zstandard

        both, shorten = aligner(of), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = 0
            for texts in in_parts(batch.column(1).to_pylist(), part):
                rows, codes = [], [np.empty(0, np.int64)]
                for text in texts:
                    found = both.align(text)
                    groups = both.written(found)
                    digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                    overlaps = int((found.last - found.first + 1).sum())
                    rows.append((len(found.a), len(found.b), len(found.at_a), overlaps, digest))
                    codes.append(found.a[found.at_a] << B_BITS | found.b[found.at_b])
                pairs, links, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
                order = np.argsort(-counts, kind="stable")
                place = np.empty(len(order), "<u4")
                place[order] = np.arange(len(order))
                ids = batch.column(0).slice(at, len(texts))
                columns = [ids, *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), list(DOC.values())[1:], strict=True))]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), c) for c in columns]
                lists += [pa.array([x[order]], pa.list_(pa.int64())) for x in (pairs, counts)]
                # the low and the high half of each number apart: the high ones are mostly zero
                halves = np.ascontiguousarray(place[links].view("<u2").reshape(-1, 2).T)
                lists.append(pa.array([shorten(halves.tobytes())], pa.binary()))
                yield pa.RecordBatch.from_arrays(lists, names=[*DOC, "pairs", "counts", "links"])
                at += len(texts)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    arrays = [f"{name} array<{KINDS[kind]}>" for name, kind in DOC.items()]
    found = own.mapInArrow(run, ", ".join([*arrays, "pairs array<long>", "counts array<long>", "links binary"]))
    return cut(found.withColumn("block", F.monotonically_increasing_id()), "blocks")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links that hold the pair, over all blocks; whether no pair of its B id has more."""
    both = F.inline(F.arrays_zip("pairs", "counts"))
    totals = cut(aligned.select(both).groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")), "totals")
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    # one row for each entry of B, 65,536 at most
    most = totals.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return totals.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def digests(docs: DataFrame, of: Tokenizers, part: int = PART) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_overlaps, groups_sha256, n_links, n_best, count_sum of every text."""
    aligned = blocks(docs, of, part)
    asked = aligned.select("block", F.posexplode("pairs").alias("k", "pair"))
    told = asked.join(pair_counts(aligned), "pair").groupBy("block")
    told = told.agg(F.array_sort(F.collect_list(F.struct("k", "n", "best"))).alias("told"))
    told = told.select("block", F.col("told.n").alias("n"), F.col("told.best").cast("array<long>").alias("best"))
    names = [*DOC, "n_links", "n_best", "count_sum"]

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                *columns, links, n, best = (column.slice(row, 1) for column in batch.columns)
                columns = [column.flatten() for column in columns]
                low, high = np.frombuffer(expand(links[0].as_py()), "<u2").reshape(2, -1).astype(np.int64)
                links = low | high << 16
                sizes = columns[names.index("n_groups")].to_numpy()
                ends = np.cumsum(sizes)
                sums = []
                for column in (best, n):
                    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(links) else np.empty(0, np.int64)
                    running = np.concatenate([[0], np.cumsum(values[links])])
                    sums.append(pa.array(running[ends] - running[ends - sizes]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), *sums], names=names)

    kinds = [f"{name} {KINDS[DOC.get(name, pa.int64())]}" for name in names]
    return aligned.join(told, "block", "left").select(*DOC, "links", "n", "best").mapInArrow(run, ", ".join(kinds))
