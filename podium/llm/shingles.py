"""Near copies by the Jaccard similarity of their sets of word shingles, for the pipeline.

Words are those of operator 6 (simhash.py): cut at space and 09 to 0D, A-Z lower-cased; a text of fewer words than a shingle
has is one shingle, a text without words has none. Texts with the same set are one class. Two classes link if their sets'
similarity is at least the one asked for.

Search. Candidates come from operator 6 first: classes whose fingerprints its Golay keys put into one group meet the group's
smallest class. They can't find all: at a similarity of 0.8 two fingerprints of 64 bits differ by 10 bits on average and by
18 now and then, and keys for 18 bits would be met by chance everywhere. So all classes also have BANDS MinHash keys of ROWS
minima each, and a pair at 0.8 shares none with a chance of (1 - 0.8^5)^60 = 5e-11. Every candidate is verified on the whole
sets of 64-bit hashes, which are written for candidates only.

Groups, as in operator 6: a bucket of two is one candidate pair; in a larger one members are compared with the smallest
member, then, where several components are left, with another centre, at last the members outside the largest component
with the members of all other components. Of these, a pair's sets are fetched only where it can be near: shingles that no
other component holds can't be common, nor those whose bit another class's map lacks (``held``). Both are bounds, not guesses,
so no link between different components is lost. Families whose members lie below the similarity mostly fall to them.
Classes that are in one component already are not compared again.

A null text counts as empty. Rows without doc_id take part like others; a class's ``first`` is null if all its rows lack one.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import bit_map, bit_of, cut, map_texts, on_bits, on_map, prepare, tidy
from podium.llm.components import components
from podium.llm.windows import mix, prefix_sums, span_hash

BANDS, ROWS = 60, 5
#: Odd factors, one for each minimum.
FACTORS = np.random.default_rng(80).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z become a-z; all other bytes stay.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Shingles hashed at once, and taken into the minima at once.
CHUNK, BLOCK = 1 << 16, 1 << 9
#: Rounds in which a large bucket's members meet one member of its largest component.
CENTRES = 1
#: Bits that stand for a class's shingles where pairs are chosen.
MARKS = 1 << 10
#: Bytes of whole sets after which a batch is sent on.
SENT = 1 << 20


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line = np.frombuffer(b" ".join(words), np.uint8)
    gaps = np.flatnonzero(line == 32)
    width = min(shingle, len(words))
    starts = np.concatenate([[0], gaps + 1])[: len(words) - width + 1]
    ends = np.concatenate([gaps, [len(line)]])[width - 1 :]
    found = []
    for at in range(0, len(starts), CHUNK):
        a, b = starts[at : at + CHUNK], ends[at : at + CHUNK]
        found.append(np.unique(span_hash(prefix_sums(line[a[0] : b[-1]]), a - a[0], b - a[0])))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK] * FACTORS).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def set_number(data: bytes) -> int:
    """Hash of a set's bytes, as a signed number."""
    from xxhash import xxh64_intdigest

    n = xxh64_intdigest(data)
    return n - (1 << 64 if n >> 63 else 0)


def sets(docs: DataFrame, shingle: int, fingerprint) -> DataFrame:
    """(doc_id, node, size, keys, fp): node is a hash of the set, keys those of its bands, fp what ``fingerprint`` says of
    the text, as a signed number."""

    def of(text):
        hashes = shingle_set(text, shingle)
        fp = fingerprint(text)
        return set_number(hashes.tobytes()), len(hashes), band_keys(hashes), fp - (1 << 64 if fp >> 63 else 0)

    return map_texts(docs, lambda: of, [("node", "long"), ("size", "long"), ("keys", "array<long>"), ("fp", "long")])


def whole_sets(docs: DataFrame, shingle: int, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted classes, from one text each: the sets are made again for those alone."""
    prepare(docs.sparkSession)
    chosen = classes.join(wanted, "node", "left_semi").where("first IS NOT NULL").select(F.col("first").alias("doc_id"))
    shared = bit_map(chosen, "doc_id")

    def as_batch(found):
        nodes, datas = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(datas, pa.binary())], names=["node", "shingles"])

    def run(batches):
        sent = set()
        for batch in batches:
            at, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            hit = on_bits(shared.value, at) | batch.column(1).is_null().to_numpy(zero_copy_only=False)
            found, held = [], 0
            for text in batch.column(2).filter(pa.array(hit)):
                data = shingle_set(text.as_py() or "", shingle).tobytes()
                if (node := set_number(data)) not in sent:
                    sent.add(node)
                    found.append((node, data))
                    held += len(data)
                if held > SENT:
                    yield as_batch(found)
                    found, held = [], 0
            if found:
                yield as_batch(found)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(bit_of("doc_id"), "doc_id", "text")
    made = own.mapInArrow(tidy(run), "node long, shingles binary").join(wanted, "node", "left_semi")
    return cut(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "whole")


def similar(pairs: DataFrame, whole: DataFrame, classes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b) of the candidate pairs whose similarity is at least least[0] / least[1], from their whole sets."""
    up, down = least
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}")), end)
    # the smaller set can't hold more than all of itself
    pairs = pairs.where(F.least("size_a", "size_b") * down >= F.greatest("size_a", "size_b") * up).select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(whole.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)

    def near(x: bytes, y: bytes) -> bool:
        total = (len(x) + len(y)) // 8
        both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common * down >= (total - common) * up

    def run(batches):
        for batch in batches:
            keep = [near(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(pairs.select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long"), "similar")


def held(wanted: DataFrame, whole: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(node, size, shared, marks) of the wanted classes (node, label) that may link with one of another component.

    ``shared`` is the number of a class's shingles that wanted classes of other components hold too. Two such classes have
    at most the lesser of their numbers in common; a class whose own number falls short of its size links with none.
    ``marks`` has a bit set for each shingle's hash, by MARKS bits in 64-bit words: as many shingles as one map has bits that
    another has not, at least, stand in the one class alone.
    """
    up, down = least

    def run(batches):
        for batch in batches:
            for node, label, data in zip(*batch.columns, strict=True):
                hashes = np.frombuffer(data.as_py(), np.int64)
                for at in range(0, len(hashes), CHUNK):
                    part = pa.array(hashes[at : at + CHUNK])
                    yield pa.RecordBatch.from_arrays([part, *(pa.repeat(x, len(part)) for x in (node, label))], names=["hash", "node", "label"])

    sets = cut(whole.join(wanted.select("node", "label").distinct(), "node").select("node", "label", "shingles"), "contested")
    rows = sets.mapInArrow(tidy(run), "hash long, node long, label long")
    own = rows.groupBy("hash").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high").select("hash")
    alone = rows.select("hash", "node").join(own, "hash", "left_semi").groupBy("node").agg(F.count("*").alias("alone"))
    size = (F.octet_length("shingles") / 8).cast("long")
    found = sets.join(alone, "node", "left").withColumn("size", size)
    found = found.select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"), "shingles")
    found = found.where(F.col("shared") * down >= F.col("size") * up)

    def mark(batches):
        for batch in batches:
            rows = []
            for data in batch.column(3):
                bits = np.zeros(MARKS, bool)
                bits[np.frombuffer(data.as_py(), np.uint64) % np.uint64(MARKS)] = True
                rows.append(np.packbits(bits, bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int64()))], names=["node", "size", "shared", "marks"])

    return cut(found.mapInArrow(tidy(mark), "node long, size long, shared long, marks array<long>"), "held")


def only(one: str, other: str) -> Column:
    """How many bits the map ``one`` has that ``other`` has not."""
    both = F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(both, F.lit(0), lambda total, x: total + x)


def between(mixed: DataFrame, whole: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs of different components of a bucket that may be near, each pair once.

    ``mixed`` has (key, node, label, main): the buckets' members, and the label of the bucket's largest component.
    """
    up, down = least
    mixed = cut(mixed.select("key", "node", "label", "main"), "mixed")
    mixed = cut(mixed.join(held(mixed, whole, least), "node"), "mixed")
    buckets = mixed.groupBy("node").agg(F.collect_list("key").alias("keys"))  # BANDS at most
    mixed = cut(mixed.join(buckets, "node"), "mixed")
    a, b = (mixed.select("key", *[F.col(c).alias(f"{c}_{end}") for c in mixed.columns if c != "key"]) for end in "ab")
    pairs = a.where("label_a <> main_a").join(b, "key")
    # both ends outside the largest component: such a pair is met from either end
    pairs = pairs.where("label_a <> label_b and (label_b = main_b or node_a < node_b)")
    common = [F.col("shared_a"), F.col("shared_b"), *(F.col(f"size_{x}") - only(f"marks_{x}", f"marks_{y}") for x, y in ("ab", "ba"))]
    for most in common:
        pairs = pairs.where(most * (up + down) >= (F.col("size_a") + F.col("size_b")) * up)
    first = F.array_min(F.array_intersect("keys_a", "keys_b"))
    return pairs.where(F.col("key") == first).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def class_labels(docs: DataFrame, shingle: int, found: DataFrame, classes: DataFrame, grouped: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(node, label) of the classes that link with another one.

    ``grouped`` has (node, group): classes whose fingerprints are near each other.
    """
    keys = cut(found.select(F.explode("keys").alias("key"), "node").distinct(), "keys")
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre"), F.max("node").alias("other"))
    buckets = cut(buckets.where("n > 1"), "buckets")
    large = buckets.where("n > 2").select("key", "centre")
    members = cut(on_map(keys, large).join(large, "key").select("key", "node", "centre"), "members")
    twos = buckets.where("n = 2").select(F.col("centre").alias("a"), F.col("other").alias("b"))
    centres = grouped.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    near = cut(grouped.join(centres, "group").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")), "near")
    ends = [df.select(F.col(c).alias("node")) for df, c in ((members, "node"), (twos, "a"), (twos, "b"), (near, "a"), (near, "b"))]
    wanted = ends[0]
    for more in ends[1:]:
        wanted = wanted.union(more)
    whole = whole_sets(docs, shingle, classes, cut(wanted.distinct(), "wanted"))
    links = similar(near, whole, classes, least)
    labels = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs that are not in one component yet."""
        for end in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
        return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    stars = members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    banded = similar(apart(stars.union(twos)), whole, classes, least)
    logging.info("links from Golay keys: %d, from bands besides: %d", links.count(), banded.count())
    links = links.union(banded)
    labels = components(links)
    for number in range(CENTRES + 1):
        # in the larger buckets, components that may still touch
        placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        placed = cut(placed, "placed")
        chance = F.struct(F.xxhash64("node", F.lit(number)), "node")
        parts = placed.groupBy("key", "label").agg(F.count("*").alias("n"), F.max(chance)["node"].alias("one"))
        parts = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "label", "one")).alias("most"))
        parts = cut(parts.where("parts > 1").select("key", F.col("most.label").alias("main"), F.col("most.one").alias("centre")), "parts")
        if parts.isEmpty():
            break
        mixed = placed.join(parts, "key")
        if number < CENTRES:
            pairs = mixed.where("label <> main").select(F.col("node").alias("a"), F.col("centre").alias("b"))
        else:
            pairs = between(mixed, whole, least)
        more = similar(pairs, whole, classes, least)
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
    return labels
