"""Incremental, idempotent loads: new files become numbered batches, and the latest row per key is read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from podium.operators.ranking import keep_last


def read_new_files(spark: SparkSession, path: str, ddl: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON lines that have appeared under ``path`` since the last run."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).json(path)


def load_batches(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Load all that is new and stop. Each batch owns one folder, so a batch that is run again replaces itself.

    The cost of a load is that of its own rows; nothing loaded before is rewritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(target)
        )

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, target: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest row per key over all batches: the later batch wins, then ``order``."""
    return keep_last(spark.read.parquet(target), keys, [F.col("batch_id"), *order]).drop("batch_id")
