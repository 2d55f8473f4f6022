"""Session settings the operators rely on. Only unset or runtime SQL settings are touched."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Skewed join partitions are split at run time even if that costs a later shuffle, and small sides are
# broadcast only after their measured size is under Spark's threshold.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a generated method above this size is not compiled to machine code; such stages run better without it
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on; what the caller has set stays."""
    own = spark.conf.getAll
    for key, value in RUNTIME.items():
        if key not in own:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "podium", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='podium-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees; where it is unset, on a local master, one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    return _own_folder()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what uses it several times does not work it out again."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
