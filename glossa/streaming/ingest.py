"""Incremental ingestion: the batch operators on each micro-batch of new documents."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each step's rows for each micro-batch under ``out/<step>/batch=<id>``.

    Every step is document-local.  A batch overwrites its own folder, so one that is repeated after
    a failure leaves nothing twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, step in steps.items():
                step(batch).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
