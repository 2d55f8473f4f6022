"""Operator 6, SimHash near-dedup by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: lower-cased in A-Z, the words of the whole text form shingles, and a bit is 1 if it
is set in over half of the shingles' XXH64 hashes. Fingerprints link at MAX_BITS = 4 or fewer differing bits.

Search. A fingerprint is cut into segments of 22, 21 and 21 bits. Of at most four differing bits, the two least hit
segments, P and Q, hold at most two together, so some word is at most one bit away from both fingerprints there. Each
fingerprint has, for every way to change at most one bit of P or Q, a key made of the number of the Golay codeword nearest
to P and of Q itself; two near fingerprints share the key of the word between them. Nearby words have the same codeword,
so the 22 changes of P give about six distinct keys. Every candidate is verified.

Groups. Equal fingerprints are one class. A bucket of two is one candidate pair, known from the bucket's aggregate. The
members of larger ones are fetched by a join, to which a bit map of fixed size lets through all keys of such buckets and
few others; where so many buckets are large that the map fills up, the join gets more rows and gives the same ones. In a
larger bucket, members link to the smallest if near it (a star, not all pairs); components of these links are taken. Buckets
that then still hold several components are looked at again: members outside the bucket's largest component are compared
with the members of other components. So a group of near copies of any size costs links in proportion to its members, and
no link between different groups is lost.

A null text counts as empty; a text without words has fingerprint zero, linked like any other. Rows without doc_id take
part; they have no doc_id to offer as component_id. Repeated rows stay, with equal results. An empty table gives no
rows. Extra columns are not read by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm import golay, shingles
from podium.llm.common import cut, map_texts, on_map, tidy
from podium.llm.components import components

MAX_BITS = 4
SEED = 42
#: (lowest bit, bits) of the segments, and the pairs of segments (by codeword, as it is) that make keys.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: A-Z become a-z; all other bytes stay.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Shingles counted at once, so that a very long text takes no more memory.
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """Bits set in over half of the hashes of the text's word shingles; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    # bytes.split takes just the white space of the contract: space and 09 to 0D
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(line)]])
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > len(starts)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed number."""

    def make():
        return lambda text: ((f := fingerprint(text, shingle)) - (1 << 64 if f >> 63 else 0),)

    return map_texts(docs, make, [("fp", "long")])


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) of all distinct keys."""
    words = fps.view(np.uint64)
    # column 0: the segment itself; the others: with one bit changed
    near = [
        np.stack([s, *(s ^ np.uint32(1 << b) for b in range(size))], axis=1)
        for low, size in SEGMENTS
        for s in [((words >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.uint32)]
    ]
    at, keys = [], []
    for number, (p, q) in enumerate(PAIRS):
        coded, exact = golay.index(near[p]).astype(np.int64), near[q].astype(np.int64)
        made = np.hstack([coded << 22 | exact[:, :1], coded[:, :1] << 22 | exact[:, 1:]])
        made = np.sort(made | number << 34, axis=1)
        fresh = np.ones(made.shape, bool)
        fresh[:, 1:] = made[:, 1:] != made[:, :-1]
        rows, columns = np.nonzero(fresh)
        at.append(rows)
        keys.append(made[rows, columns])
    return np.concatenate(at), np.concatenate(keys)


def keyed(classes: DataFrame) -> DataFrame:
    """(key, fp) of every class."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            at, keys = golay_keys(np.ascontiguousarray(fps))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps[at], pa.int64())], names=["key", "fp"])

    return classes.select("fp").mapInArrow(tidy(run), "key long, fp long")


def near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def class_labels(classes: DataFrame) -> DataFrame:
    """(node, label) of the fingerprints that link with another one."""
    # a class has many keys: it is dealt out before they are made
    spread = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = cut(keyed(classes.repartition(spread, "fp")), "keys")
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("centre"), F.max("fp").alias("other"))
    buckets = cut(buckets.where("n > 2 or (n = 2 and bit_count(centre ^ other) <= %d)" % MAX_BITS), "buckets")
    # two members are known from the aggregate; only larger buckets fetch theirs
    pairs = buckets.where("n = 2").select(F.col("other").alias("a"), F.col("centre").alias("b"))
    large = buckets.where("n > 2").select("key", "centre")
    members = cut(on_map(keys, large).join(large, "key").select("key", "fp", "centre"), "members")
    stars = members.where((F.col("fp") != F.col("centre")) & near("fp", "centre")).select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    stars = cut(stars.union(pairs).distinct(), "stars")
    labels = components(stars)
    # in the larger buckets, components that may still touch
    open_members = members.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
    open_members = cut(open_members.select("key", "fp", F.coalesce("label", "fp").alias("label")), "open")
    sizes = open_members.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "label")).alias("most"))
    largest = cut(largest.where("parts > 1").select("key", F.col("most.label").alias("main")), "largest")
    mixed = cut(open_members.join(largest, "key"), "mixed")
    few = mixed.where("label <> main").select("key", F.col("fp").alias("a"), F.col("label").alias("of_a"))
    pairs = few.join(mixed.select("key", F.col("fp").alias("b"), F.col("label").alias("of_b")), "key").where(
        (F.col("of_a") != F.col("of_b")) & near("a", "b")
    )
    more = cut(pairs.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), "more")
    if more.isEmpty():
        return labels
    merged = components(more).select(F.col("node").alias("label"), F.col("label").alias("root"))
    # ends of the later links that had no link before are nodes of their own
    own = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    own = own.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    labels = labels.unionByName(own).join(merged, "label", "left")
    return cut(labels.select("node", F.coalesce("root", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, shingle: int = 4, similarity: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Documents link by their fingerprints or, where a similarity is given as a fraction, by the Jaccard similarity of their
    sets of shingles; the fingerprints' Golay keys give the first candidates then (shingles.py).
    """
    if similarity:
        found = cut(shingles.sets(docs, shingle, partial(fingerprint, shingle=shingle)), "sets")
        classes = cut(found.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("size").alias("size")), "classes")
        fps = cut(found.select("node", "fp").distinct(), "fps")
        near_fps = class_labels(fps.select("fp").distinct()).select(F.col("node").alias("fp"), "label")
        grouped = cut(fps.join(near_fps, "fp", "left").select("node", F.coalesce("label", "fp").alias("group")), "grouped")
        labels = shingles.class_labels(docs, shingle, found, classes, grouped, similarity)
        return verdicts(found.drop("keys"), classes, labels, "node").select("doc_id", "fp", "component_id")
    found = cut(fingerprints(docs, shingle), "fingerprints")
    classes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    return verdicts(found, classes, class_labels(classes), "fp").select("doc_id", "fp", "component_id")


def verdicts(found: DataFrame, classes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The rows of found with component_id, the smallest doc_id of all classes that links reach."""
    grouped = classes.join(labels.select(F.col("node").alias(key), "label"), key, "left")
    grouped = cut(grouped.select(key, "first", F.coalesce("label", key).alias("label")), "grouped")
    firsts = cut(grouped.groupBy("label").agg(F.min("first").alias("component_id")), "firsts")
    grouped = cut(grouped.join(firsts, "label").select(key, "component_id"), "grouped")
    return found.join(grouped, key)


def hexadecimal(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] | None = (4, 5)) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id is their component's smallest.

    Rows that share such a doc_id count as one document: the one with the smallest text stays. Rows without doc_id, which
    no verdict can name, stay.
    """
    result = cut(near_duplicates(docs, shingle, similarity).select("doc_id", "component_id"), "near")
    stays = result.where(F.col("doc_id") == F.col("component_id"))
    stays = cut(stays.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows")), "stays")
    single = stays.where("rows = 1")
    kept = docs.join(single, docs["doc_id"] == single["kept_id"], "left_semi").union(docs.where(docs["doc_id"].isNull()))
    several = stays.where("rows > 1")
    if several.isEmpty():
        return kept
    again = docs.join(several, docs["doc_id"] == several["kept_id"], "left_semi")
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*again.columns), F.coalesce("text", F.lit(""))).alias("row"))
    return kept.unionByName(first.select("row.*"))
