"""Operator 2, benchmark decontamination by template canonicalisation.

A whole text becomes a row of tokens, in which numbers, units after numbers and names (capitalised words inside a
sentence; adjacent ones are one name) give way to typed placeholders; other words count in lower case. Windows of WIDTH
tokens of documents are hash-joined with those of the benchmark's items, so a question with other names and numbers still
meets its template. Windows need MIN_LITERALS words that are no placeholders.

Matches of one document and item at one distance (alignment) are then checked for slot consistency: a value of the item
must always stand for the same value of the document. An alignment leaks the item if it has NEEDED windows
(or all windows of a shorter item) and its slots are consistent, or so many windows without any slot.

Items without such a window, short or dense in numbers and names, are looked for word for word: by windows of WIDTH words
as they stand, or by the whole of a shorter item, whatever words these are. They are not found with other values.

The first pass keeps only windows whose hash hits a bit map of the benchmark's window hashes (2 MB at any size of either
side); the join decides. A null text counts as empty; an item without any word is never found.
Rows that repeat a doc_id are told apart by a hash of the text; rows without doc_id are judged as others are. Repeated items
and repeated rows change no verdict; ties for the best item go to the smaller item_id. Without documents or items there
is nothing to find. Extra columns are not read by ``find_leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import cut, prepare
from podium.llm.windows import mix, prefix_sums, span_hash

WIDTH = 8
MIN_LITERALS = 5
#: Windows that an alignment needs; side by side they span thirteen tokens.
NEEDED = 6
BITS = 24
#: Bytes of a text handled at once; cut after a line or a word.
PIECE = 1 << 22

# Words that are units where they follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg oz lb lbs gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter "
    "liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years percent degree degrees dollar dollars cent cents euro euros mph kph"
).split()

OTHER, LOWER_LETTER, UPPER_LETTER, DIGIT = range(4)
CLASS = np.array(
    [
        DIGIT if 0x30 <= b <= 0x39 else UPPER_LETTER if 0x41 <= b <= 0x5A else LOWER_LETTER if 0x61 <= b <= 0x7A or b >= 0x80 else OTHER
        for b in range(256)
    ],
    np.uint8,
)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: Bytes before a space after which a capital is no start of a sentence.
INSIDE = (CLASS > 0) | np.isin(np.arange(256), list(b",;)'\"-"))
NUMBER, UNIT, NAME = (np.uint64(0xA5A5_0000_0000_0000 + k) for k in (1, 2, 3))


def word_hash(words: list[str]) -> np.ndarray:
    return np.array([span_hash(prefix_sums(a := np.frombuffer(w.encode(), np.uint8)), np.array([0]), np.array([len(a)]))[0] for w in words], np.uint64)


UNIT_HASHES = np.sort(word_hash(UNITS))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kinds, starts, ends, values): classes of the bytes, words, and hashes of the words in lower case."""
    kinds = CLASS[data]
    inside = kinds > 0
    if len(data) > 2:
        digit = kinds == DIGIT
        inside[1:-1] |= ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    return kinds, starts, ends, span_hash(prefix_sums(LOWER[data]), starts, ends)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, value, slot): token hashes, hashes of the words they stand for, whether they are placeholders."""
    kinds, starts, ends, values = spans(data)
    first = kinds[starts]
    number = first == DIGIT
    name = (first == UPPER_LETTER) & (ends - starts > 1) & (starts > 1)
    at = starts[name]
    name[name] = (kinds[at + 1] == LOWER_LETTER) & (data[at - 1] == 0x20) & INSIDE[data[at - 2]]
    unit = np.zeros(len(starts), bool)
    after = np.flatnonzero(number[:-1] & ~number[1:]) + 1
    unit[after] = np.isin(values[after], UNIT_HASHES)
    token = values.copy()
    token[number], token[unit], token[name & ~unit] = NUMBER, UNIT, NAME
    slot = number | unit | name
    again = np.zeros(len(starts), bool)
    again[1:] = name[1:] & name[:-1]
    if again.any():
        # the value of a name of several words
        group = np.cumsum(~again) - 1
        joined = np.zeros(group[-1] + 1, np.uint64)
        np.add.at(joined, group, mix(values + again.astype(np.uint64)))
        values = np.where(name, joined[group], values)
        token, values, slot = token[~again], values[~again], slot[~again]
    return token, values, slot


def pieces(text: str):
    data = text.encode("utf-8", "surrogatepass")
    begin = 0
    while begin < len(data):
        end = len(data)
        if end - begin > PIECE:
            end = max(data.rfind(b"\n", begin, begin + PIECE), data.rfind(b" ", begin, begin + PIECE), begin + PIECE // 2) + 1
        yield np.frombuffer(data, np.uint8, end - begin, begin)
        begin = end


def window_rows(text: str):
    """For the pieces of a text: (number of the first window, window hashes, enough literals, values, slots)."""
    tail = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool))
    done = 0
    for data in pieces(text):
        token, value, slot = (np.concatenate(x) for x in zip(tail, tokens(data), strict=True))
        count = len(token) - WIDTH + 1
        if count > 0:
            hashes = np.zeros(count, np.uint64)
            for k in range(WIDTH):
                hashes *= np.uint64(0x9E3779B97F4A7C15)
                hashes += token[k : k + count]
            slots = np.concatenate([[0], np.cumsum(slot)])
            literal = WIDTH - (slots[WIDTH:] - slots[:-WIDTH]) >= MIN_LITERALS
            yield done, mix(hashes), literal, value, slot
            done += count
        keep = min(WIDTH - 1, len(token))
        tail = tuple(x[len(x) - keep :] for x in (token, value, slot))


def windows(rows: DataFrame, key: str, chosen: bytes | None = None) -> DataFrame:
    """(key, th, hash, place, slots) of the windows of (key, th, text); only those on the bit map where one is given."""
    names = [key, "th", "hash", "place", "slots"]

    def run(batches):
        bits = None if chosen is None else np.frombuffer(chosen, np.uint8)
        for batch in batches:
            out = []
            for k, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for done, hashes, literal, value, slot in window_rows(text):
                    if bits is not None:
                        bit = hashes >> np.uint64(64 - BITS)
                        literal &= (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    for at in np.flatnonzero(literal).tolist():
                        here = slot[at : at + WIDTH]
                        slots = value[at : at + WIDTH][here].view(np.int64).tolist() if here.any() else []
                        out.append((k, th, int(hashes[at].view(np.int64)), done + at, slots))
                    if len(out) > 20_000:
                        yield window_batch(out, names)
                        out = []
            if out:
                yield window_batch(out, names)

    prepare(rows.sparkSession)
    return rows.mapInArrow(run, f"{key} long, th long, hash long, place long, slots array<long>")


def word_windows(rows: DataFrame, key: str, widths: list[int] | None = None, chosen: bytes | None = None) -> DataFrame:
    """(key, th, hash, place) of windows of words as they stand, of all widths; only those on the bit map.

    Without widths, those of an item: WIDTH words each, or one of all words of a shorter text; with width, its words.
    """
    fields = [key, "th", "hash", "place", "width"]

    def run(batches):
        bits = None if chosen is None else np.frombuffer(chosen, np.uint8)
        for batch in batches:
            for k, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tail, done = np.empty(0, np.uint64), 0
                for data in pieces(text):
                    # done words before the tail, which is in all windows that reach into this piece
                    words = np.concatenate([tail, spans(data)[3]])
                    for width in widths or [min(WIDTH, len(words))]:
                        # shorter windows inside the tail were in the last piece
                        first = max(0, len(tail) - width + 1)
                        count = len(words) - width + 1 - first
                        if count <= 0 or not width:
                            continue
                        hashes = np.full(count, width, np.uint64)
                        for j in range(width):
                            hashes *= np.uint64(0x9E3779B97F4A7C15)
                            hashes += words[first + j : first + j + count]
                        hashes = mix(hashes)
                        at = np.arange(count)
                        if bits is not None:
                            bit = hashes >> np.uint64(64 - BITS)
                            at = at[(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                        for part in np.array_split(at, max(1, -(-len(at) // 20_000))):
                            n = len(part)
                            columns = [pa.repeat(pa.scalar(k, pa.int64()), n), pa.repeat(pa.scalar(th, pa.int64()), n)]
                            columns += [pa.array(hashes[part].view(np.int64)), pa.array(done + first + part), pa.array(np.full(n, width))]
                            yield pa.RecordBatch.from_arrays(columns, names=fields)
                    keep = min(WIDTH - 1, len(words))
                    done += len(words) - keep
                    tail = words[len(words) - keep :]

    prepare(rows.sparkSession)
    return rows.mapInArrow(run, f"{key} long, th long, hash long, place long, width long")


def window_batch(rows, names) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), kinds)), names=names)


def keyed(rows: DataFrame, key: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = rows.select(F.col(key).cast("long").alias(key), text.alias("text"))
    return own.select(key, F.xxhash64("text").alias("th"), "text")


def bit_map(items: DataFrame) -> bytes:
    """Which of 2^BITS hash prefixes the benchmark's windows have. At most 2^(BITS - 16) rows of fixed size are collected."""
    prefix = F.shiftrightunsigned("hash", 64 - BITS)
    parts = items.select((prefix / 65536).cast("int").alias("part"), (prefix % 65536).cast("int").alias("bit")).distinct()
    block = parts.groupBy("part").agg(F.collect_set("bit").alias("bits"))
    found = np.zeros(1 << BITS, bool)
    for row in block.toLocalIterator():
        found[row["part"] * 65536 + np.array(row["bits"])] = True
    return np.packbits(found, bitorder="little").tobytes()


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(did, th, n_items, best_item, n_windows, share, slots_changed) of the texts that leak an item."""
    items = cut(windows(keyed(benchmark, "item_id"), "item_id").distinct(), "items")
    totals = items.groupBy("item_id", F.col("th").alias("item_th")).agg(F.count_distinct("place").alias("total"))
    hits = windows(keyed(docs, "doc_id"), "doc_id", bit_map(items))
    hits = hits.select(F.col("doc_id").alias("did"), "th", "hash", F.col("place").alias("at"), F.col("slots").alias("values"))
    own = items.select("item_id", F.col("th").alias("item_th"), "hash", "place", "slots")
    matches = hits.join(own, "hash").where(F.size("slots") == F.size("values"))
    matches = cut(matches.select("did", "th", "item_id", "item_th", (F.col("at") - F.col("place")).alias("shift"), "place", "slots", "values"), "matches")
    alignment = ["did", "th", "item_id", "item_th", "shift"]
    counts = matches.groupBy(alignment).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.size("slots") == 0, 1).otherwise(0)).alias("plain"),
        F.max(F.col("slots") != F.col("values")).alias("changed"),
    )
    pairs = matches.where(F.size("slots") > 0).select(*alignment, F.explode(F.arrays_zip("slots", "values")).alias("pair"))
    stands_for = pairs.groupBy(*alignment, "pair.slots").agg((F.min("pair.values") != F.max("pair.values")).alias("conflict"))
    conflicts = stands_for.groupBy(alignment).agg(F.max("conflict").alias("conflict"))
    on = [counts[c].eqNullSafe(conflicts[c]) for c in alignment]
    judged = counts.join(conflicts, on, "left").select(*[counts[c] for c in alignment], "n", "plain", "changed", F.coalesce("conflict", F.lit(False)).alias("conflict"))
    item = ["item_id", "item_th"]
    judged = judged.join(totals, [judged[c].eqNullSafe(totals[c]) for c in item]).drop(*[totals[c] for c in item])
    needed = F.least(F.lit(NEEDED), F.col("total"))
    leaks = judged.where(((F.col("n") >= needed) & ~F.col("conflict")) | (F.col("plain") >= needed))
    leaks = leaks.select("did", "th", *item, "n", "total", "changed", F.lit(True).alias("template"))
    leaks = leaks.unionByName(verbatim_leaks(docs, benchmark, totals))
    best = F.max_by(
        F.struct("item_id", "n", (F.col("n") / F.col("total")).alias("share"), "changed"),
        F.struct("template", "n", -F.coalesce("item_id", F.lit(0))),
    )
    found = leaks.groupBy("did", "th").agg(F.count_distinct("item_id", "item_th").alias("n_items"), best.alias("best"))
    return found.select(
        "did", "th", "n_items", F.col("best.item_id").alias("best_item"), F.col("best.n").alias("n_windows"),
        F.col("best.share").alias("share"), F.col("best.changed").alias("slots_changed"),
    )


def verbatim_leaks(docs: DataFrame, benchmark: DataFrame, totals: DataFrame) -> DataFrame:
    """(did, th, item_id, item_th, n, total, changed, template): word for word, the items that have no template window."""
    rest = keyed(benchmark, "item_id").distinct()
    on = rest["item_id"].eqNullSafe(totals["item_id"]) & (rest["th"] == totals["item_th"])
    items = cut(word_windows(rest.join(totals, on, "left_anti"), "item_id"), "rest")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most WIDTH rows
    item = ["item_id", "item_th"]
    items = items.withColumnRenamed("th", "item_th")
    sizes = items.groupBy(F.col("item_id").alias("of_id"), F.col("item_th").alias("of_th")).agg(F.count("*").alias("total"))
    if widths:
        hits = word_windows(keyed(docs, "doc_id"), "doc_id", widths, bit_map(items)).select(F.col("doc_id").alias("did"), "th", "hash", F.col("place").alias("at"))
    else:
        hits = items.select(F.col("item_id").alias("did"), F.col("item_th").alias("th"), "hash", F.col("place").alias("at")).limit(0)
    counts = hits.join(items.select(*item, "hash", "place"), "hash").groupBy("did", "th", *item, (F.col("at") - F.col("place")).alias("shift"))
    counts = counts.agg(F.count("*").alias("n"))
    found = counts.join(sizes, F.col("item_id").eqNullSafe(F.col("of_id")) & (F.col("item_th") == F.col("of_th")))
    found = found.where(F.col("n") >= F.least(F.lit(NEEDED), F.col("total")))
    return found.select("did", "th", *item, "n", "total", F.lit(False).alias("changed"), F.lit(False).alias("template"))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every document: what it leaks, and whether it is contaminated."""
    found = cut(find_leaks(docs, benchmark), "leaks")
    rows = keyed(docs, "doc_id").select("doc_id", F.col("th").alias("own_th"))
    on = rows["doc_id"].eqNullSafe(found["did"]) & (rows["own_th"] == found["th"])
    return rows.join(found, on, "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), "best_item",
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("share", F.lit(0.0)).alias("share"),
        F.coalesce("slots_changed", F.lit(False)).alias("slots_changed"), F.col("th").isNotNull().alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that leak no item."""
    found = cut(find_leaks(docs, benchmark), "leaks").select(F.col("did").alias("_own_did"), F.col("th").alias("_own_th"))
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("_own_did")) & (th == F.col("_own_th"))
    return docs.join(found, on, "left_anti")
