"""Helpers shared by the operators: shared folder, cut lineage, bounded Arrow batches, label splits."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow batches stay small, so that a Python worker's memory does not depend on the length of texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@functools.cache
def _ship_package(application: str) -> None:
    """Send this package to the Python workers, which need not see the driver's folders."""
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="podium-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    SparkContext.getOrCreate().addPyFile(str(archive))


def prepare(spark: SparkSession) -> None:
    """Before Python stages: ship the code once, lower the size of Arrow batches; smaller settings stay."""
    _ship_package(spark.sparkContext.applicationId)
    for key, most in BATCH.items():
        now = str(spark.conf.get(key, str(most))).lower().removesuffix("b")
        scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
        value = int(now.rstrip("kmg")) * scale
        if not 0 < value <= most:
            spark.conf.set(key, str(most))


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='podium-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, as in tests, a folder of the local machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    return _own_folder()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that lost executors cost no recomputation of it.

    Shuffle files of the write go when it has ended; what follows reads the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the map of a join's keys: 8 MB at any size of the input.
MAP_BITS = 26


def bit_of(key: str) -> Column:
    """A key's place on a bit map."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - MAP_BITS).alias("bit")


def bit_map(few: DataFrame, key: str = "key"):
    """Bit map of few's keys, sent to all executors; its size does not depend on their number."""
    words = few.select(bit_of(key)).groupBy(F.shiftright("bit", 6).alias("word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("bits")).toArrow()  # at most 2^(MAP_BITS - 6) rows of 16 bytes
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return few.sparkSession.sparkContext.broadcast(bits)


def on_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places are set."""
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def on_map(rows: DataFrame, few: DataFrame, key: str = "key") -> DataFrame:
    """The rows whose key's hash is on the bit map of few's keys: all that a join with few finds, and some more."""
    shared, names = bit_map(few, key), rows.columns

    def run(batches):
        for batch in batches:
            hit = on_bits(shared.value, batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=names).filter(pa.array(hit))

    return rows.select(bit_of(key), *names).mapInArrow(tidy(run), rows.schema)


def tidy(run):
    """``run``, a function of Arrow batches, after whose end the worker's free memory goes back to the system.

    Workers outlive their tasks, and freed memory that they keep is lacking in the stages that follow.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


#: Seconds for which a Python worker keeps what it made after a task's end, for the next task of the same stage.
KEEP_S = 5


class Held:
    """What a Python worker makes once and keeps between tasks.

    Workers outlive their stage, and what one stage leaves in them is memory that the next ones lack; so it goes KEEP_S
    seconds after its last use.
    """

    def __init__(self, make):
        self.make, self.kept, self.timers = make, {}, {}

    def take(self, key):
        if timer := self.timers.pop(key, None):
            timer.cancel()
        if key not in self.kept:
            self.kept[key] = self.make(key)
        return self.kept[key]

    def give_back(self, key) -> None:
        timer = self.timers[key] = threading.Timer(KEEP_S, self.kept.pop, (key, None))
        timer.daemon = True
        timer.start()


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text modulo the divisor; null keys have null."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor))


def map_texts(docs: DataFrame, make, fields: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, fields...) of every row: ``make()`` is called once in a task and returns a function of one whole text.

    A null text counts as empty. The function returns a tuple of values in the order of ``fields`` (name, SQL type).
    Arrow batches are bounded, so is what a task holds.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", *(name for name, _ in fields)]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
             "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    types = [kinds[kind] for _, kind in fields]

    def run(batches):
        of = make()
        for batch in batches:
            columns = list(zip(*(of(text or "") for text in batch.column(1).to_pylist()), strict=True)) or [()] * len(types)
            arrays = [pa.array(values, kind) for values, kind in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    schema = ", ".join(["doc_id long", *(f"{name} {kind}" for name, kind in fields)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)
