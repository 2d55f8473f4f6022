"""Operator 9, suffix-array dedup: a logarithmic family of sparse suffix arrays finds strings that stand twice.

Every byte covered by a string of LENGTH bytes that also starts anywhere else, in the same or another text, is found;
strings are judged on the input, overlaps count, matches never cross documents.

Sparse suffixes. Only matches of LENGTH bytes matter, so only the suffixes at anchors are kept (windows.py): each window
of LENGTH bytes chooses one anchor by its content alone, so equal windows have equal anchors at equal offsets. A suffix
is ordered by the hash of its first KMER bytes, which brings suffixes that start alike together just as their own order
would; an array is a table of (first, n): how many suffixes start so.

Family. A batch of documents gets its array, which is merge-scanned against every existing level: suffixes that start
alike are candidates for long matches. The array becomes level 0; while two levels have the same number, they merge into
the next, so a suffix is merged a logarithmic number of times (``Family``).

Matches. Candidate suffixes are compared over the whole run of windows that share the anchor: where the bytes of the run
are the same elsewhere, all its windows are. What is left is one representative for each different run, whose bytes are
fetched, sorted by their first bytes and compared window by window. Of starts that hold very many different runs the
windows are dealt out by offset, but every such task gets the bytes of all runs of the start.

A null text counts as empty. Rows without doc_id take part as others do. Rows that repeat a doc_id are told apart by a
hash of their texts; repeated rows with one text are occurrences of their own and have equal results. An empty table
gives no rows. Extra columns are not read by ``repeated_spans`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm import windows
from podium.llm.common import prepare, cut

LENGTH = 200
BATCHES = 2
#: Different runs of one start that a task compares at once; more are dealt out by window offset.
TOGETHER = 4_096
#: A suffix's place: the first window start, and 8 bits of the further window starts.
MORE = 1 << 8


def keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text): doc_id, a hash that tells repeated doc_ids apart, and the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("did"), text.alias("text"))
    return own.select("did", F.xxhash64("text").alias("th"), "text")


def suffixes(rows: DataFrame) -> DataFrame:
    """(first, run, did, th, place) of every anchor: hashes of its first bytes and of all bytes of its windows."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            size = 0
            for did, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, whole, lo, hi, _ = windows.anchors(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), LENGTH)
                for part, values in zip(out, (first.view(np.int64), whole.view(np.int64), np.full(len(lo), th, np.int64), lo * MORE + (hi - lo)), strict=False):
                    part.append(values)
                out[4].append(pa.repeat(pa.scalar(did, pa.int64()), len(first)))
                size += len(first)
                if size > 100_000:
                    yield suffix_batch(out)
                    out, size = [[], [], [], [], []], 0
            if size:
                yield suffix_batch(out)

    prepare(rows.sparkSession)
    return rows.mapInArrow(run, "first long, run long, did long, th long, place long")


def suffix_batch(parts) -> pa.RecordBatch:
    first, whole, th, place = (pa.array(np.concatenate(p), pa.int64()) for p in parts[:4])
    return pa.RecordBatch.from_arrays([first, whole, pa.concat_arrays(parts[4]), th, place], names=["first", "run", "did", "th", "place"])


@dataclass
class Family:
    """Levels of suffix arrays, (first, n) each; level k holds about 2^k batches."""

    levels: dict[int, DataFrame] = field(default_factory=dict)

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in the suffixes of a batch; return the starts (first) of those that now stand twice because of it."""
        array = cut(batch.groupBy("first").agg(F.count("*").alias("n")), "array")
        twice = array.where("n > 1").select("first")
        for level in self.levels.values():
            twice = twice.union(array.select("first").join(level.select("first"), "first", "left_semi"))
        found = cut(twice.distinct(), "twice")
        number = 0
        while number in self.levels:
            array = self.levels.pop(number).union(array).groupBy("first").agg(F.sum("n").alias("n"))
            number += 1
        self.levels[number] = cut(array, f"level{number}") if number else array
        return found


def by_batch(rows: DataFrame, batches: int) -> list[DataFrame]:
    part = F.pmod(F.xxhash64("did", "th"), F.lit(batches))
    return [rows.where(part == k) for k in range(batches)] if batches > 1 else [rows]


def text_runs(rows: DataFrame) -> DataFrame:
    """(first, run, did, th, places): the suffixes of each text, those of equal runs in one row with ascending places."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            size = 0
            for did, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, whole, lo, hi, _ = windows.anchors(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), LENGTH)
                order = np.lexsort((lo, whole, first))
                first, whole, place = first[order], whole[order], (lo * MORE + (hi - lo))[order]
                begin = np.flatnonzero((first[1:] != first[:-1]) | (whole[1:] != whole[:-1])) + 1
                begin = np.concatenate([np.zeros(min(len(first), 1), np.int64), begin])
                for part, values in zip(out, (first[begin].view(np.int64), whole[begin].view(np.int64), np.full(len(begin), th, np.int64)), strict=False):
                    part.append(values)
                out[3].append(pa.repeat(pa.scalar(did, pa.int64()), len(begin)))
                out[4].append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(first)), pa.int32()), pa.array(place, pa.int64())))
                size += len(first)
                if size > 100_000:
                    yield run_batch(out)
                    out, size = [[], [], [], [], []], 0
            if size:
                yield run_batch(out)

    prepare(rows.sparkSession)
    return rows.mapInArrow(run, "first long, run long, did long, th long, places array<long>")


def run_batch(parts) -> pa.RecordBatch:
    first, whole, th = (pa.array(np.concatenate(p), pa.int64()) for p in parts[:3])
    did, places = map(pa.concat_arrays, parts[3:])
    return pa.RecordBatch.from_arrays([first, whole, did, th, places], names=["first", "run", "did", "th", "places"])


def candidates(rows: DataFrame, batches: int) -> DataFrame:
    """The suffixes whose first bytes stand twice in all of rows, one row for each text and run."""
    family, twice = Family(), None
    for batch in by_batch(rows, batches):
        found = family.add(suffixes(batch))
        twice = found if twice is None else twice.union(found)
    twice = cut(twice.distinct(), "twice") if batches > 1 else twice
    return cut(text_runs(rows).join(twice, "first", "left_semi"), "candidates")


def place_parts() -> list[Column]:
    place = F.col("place")
    return [
        F.shiftright(place, 8).cast("int").alias("lo"),
        F.pmod(place, F.lit(MORE)).cast("int").alias("more"),
    ]


def run_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(first, cell, did, th, lo, offset, bytes): the bytes of each wanted run, dealt out by offset where there are many.

    ``offset`` is the distance from the first window start to the anchor; in cell k of c are offsets k, k + c, ...
    """
    gathered = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("first", "cells", "lo", "more")).alias("runs"))
    gathered = gathered.select(F.col("did").alias("d"), F.col("th").alias("t"), "runs")
    joined = rows.join(gathered, rows["did"].eqNullSafe(F.col("d")) & (rows["th"] == F.col("t")))

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for did, th, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for r in runs:
                    part = data[r["lo"] : r["lo"] + r["more"] + LENGTH]
                    for cell in range(r["cells"]):
                        out.append((r["first"], cell, r["cells"], did, th, r["lo"], part))
                        size += len(part)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True), RUN_TYPES)), names=RUN_NAMES)
                            out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True), RUN_TYPES)), names=RUN_NAMES)

    return joined.select("did", "th", "text", "runs").mapInArrow(
        run, "first long, cell int, cells int, did long, th long, lo int, bytes binary"
    )


RUN_NAMES = ["first", "cell", "cells", "did", "th", "lo", "bytes"]
RUN_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def shared_windows(runs: list[bytes], cells: int, cell: int) -> list[tuple[int, int] | None]:
    """For each run of one start, its first and last window that another run also holds, by offset to the anchor."""
    hashes, of, at = [], [], []
    for k, data in enumerate(runs):
        array = np.frombuffer(data, np.uint8)
        starts = np.arange(len(array) - LENGTH + 1)
        if cells > 1:
            anchor = windows.anchors(array, LENGTH)[4][0]
            starts = starts[(anchor - starts) % cells == cell]
        hashes.append(windows.window_hashes(array, starts, LENGTH))
        of.append(np.full(len(starts), k))
        at.append(starts)
    hashes, of, at = map(np.concatenate, (hashes, of, at))
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    of, at = of[twice], at[twice]
    found: list[tuple[int, int] | None] = [None] * len(runs)
    edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        found[of[a]] = (int(at[a]), int(at[b - 1]))
    return found


def compared(runs: DataFrame) -> DataFrame:
    """(did, th, start, end) of the bytes of each run that are shared, from runs sorted by start."""
    ordered = runs.repartition("first", "cell").sortWithinPartitions("first", "cell")

    def run(batches):
        key, group = None, []

        def results():
            found = shared_windows([g[6] for g in group], group[0][2], group[0][1]) if len(group) > 1 else []
            return [(g[3], g[4], g[5] + f[0], g[5] + f[1] + LENGTH) for g, f in zip(group, found, strict=False) if f]

        out = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    out += results() if group else []
                    key, group = row[:2], []
                group.append(row)
            if out:
                yield span_batch(out)
                out = []
        if group and (out := results()):
            yield span_batch(out)

    return ordered.mapInArrow(run, "did long, th long, start int, end int")


def span_batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), kinds)), names=["did", "th", "start", "end"])


def repeated_spans(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(did, th, places): byte spans that cover just the bytes of strings of LENGTH bytes that stand elsewhere.

    A span begins at the place's window start and goes to the end of the last of its further windows.
    """
    found = candidates(rows, batches)
    one = F.min(F.struct("did", "th", F.element_at("places", 1).alias("place"))).alias("one")
    classes = found.groupBy("first", "run").agg(F.sum(F.size("places")).alias("n"), one)
    classes = cut(classes.select("first", "run", "n", "one.did", "one.th", "one.place"), "runs")
    starts = classes.groupBy("first").agg(F.count("*").alias("runs"), F.min("n").alias("fewest"))
    # starts with different runs of which one at least stands alone
    starts = cut(starts.where("runs > 1 and fewest = 1").select("first", "runs"), "starts")
    cells = F.least(F.ceil(F.col("runs") / F.lit(TOGETHER)), F.lit(LENGTH - windows.KMER + 1)).cast("int").alias("cells")
    wanted = cut(classes.join(starts.select("first", cells), "first").select("first", "cells", "did", "th", *place_parts()), "wanted")
    alone = cut(compared(run_bytes(rows, wanted)), "shared")
    repeated = cut(classes.where("n > 1").select("first", "run"), "repeated")
    whole = found.join(repeated, ["first", "run"], "left_semi").select("did", "th", "places")
    place = F.col("start").cast("long") * MORE + (F.col("end") - F.col("start") - LENGTH)
    return whole.unionByName(alone.select("did", "th", F.array(place).alias("places")))


def joined_spans(spans: DataFrame) -> DataFrame:
    """(did, th, spans): the spans (start, end) of each text in one row, sorted."""
    places = spans.groupBy("did", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("places"))

    def span(place):
        start = F.shiftright(place, 8)
        return F.struct(start.cast("int").alias("start"), (start + F.pmod(place, F.lit(MORE)) + LENGTH).cast("int").alias("end"))

    return places.select("did", "th", F.transform("places", span).alias("spans"))


def union_of(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union of sorted spans; spans that touch are one run."""
    merged: list[tuple[int, int]] = []
    for span in () if spans is None else spans:
        a, b = span["start"], span["end"]
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def remaining(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def with_spans(docs: DataFrame, batches: int) -> DataFrame:
    """The rows of docs with a column of their text's spans, named so that it can't clash."""
    spans = joined_spans(repeated_spans(keyed(docs), batches)).select(
        F.col("did").alias("_own_did"), F.col("th").alias("_own_th"), F.col("spans").alias("_own_spans")
    )
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("_own_did")) & (th == F.col("_own_th"))
    return docs.join(spans, on, "left").drop("_own_did", "_own_th")


def digests(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    import hashlib

    def run(parts):
        for batch in parts:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, runs = (text or "").encode("utf-8", "surrogatepass"), union_of(spans)
                out.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(remaining(data, runs)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            arrays = list(map(pa.array, zip(*out, strict=True), kinds)) if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    prepare(docs.sparkSession)
    own = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), batches)
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of docs, all their columns, with the repeated strings taken out of the text.

    A character of which only some bytes go, goes whole. n_chars, if there, is the length of the text that is left.
    """

    @F.pandas_udf("string")
    def left(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in parts:
            rows = zip(texts, spans, strict=True)
            yield pd.Series(
                [t if s is None else remaining(t.encode("utf-8", "surrogatepass"), union_of(s)).decode("utf-8", "ignore") for t, s in rows],
                dtype=object,
            )

    prepare(docs.sparkSession)
    columns = docs.columns
    changed = with_spans(docs, batches).withColumn("text", left(F.col("text").cast("string"), F.col("_own_spans")))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*columns)
