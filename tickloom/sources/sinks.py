"""Streaming sinks: append tables, fan-out, and a keyed upsert log.

The upsert sink stores each micro-batch under its own id and resolves keys when read. A repeated
batch overwrites its own folder, so a restart neither duplicates nor loses rows, and no stored
file is rewritten while a stream runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from ..operators.candles import latest_write
from .lake import child_names, delete_path, write_text

TRIGGER = {"processingTime": "1 minute"}
#: Folder of the marks of whole micro-batches.
COMMITS = "_committed"


def append_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False,
                  partition: Sequence[str] = ()):
    """Append-mode file sink with a checkpoint, every minute or until the input is drained."""
    writer = (df.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    if partition:
        writer = writer.partitionBy(*partition)
    trigger = {"availableNow": True} if once else TRIGGER
    return writer.trigger(**trigger).start()


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Idempotent write of one micro-batch."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")


def fan_out(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One micro-batch to several writers, computed once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for write in writers:
                write(batch, batch_id)
        finally:
            batch.unpersist()
    return run


def to_path(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    return lambda batch, batch_id: write_batch(transform(batch), batch_id, path)


def foreach_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  once: bool = False, mode: str = "append", trigger: dict | None = None):
    trigger = trigger or ({"availableNow": True} if once else TRIGGER)
    return (df.writeStream.foreachBatch(write).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def write_committed(df: DataFrame, batch_id: int, path: str) -> None:
    """Idempotent write of one micro-batch that readers see only once it is whole."""
    write_batch(df, batch_id, path)
    commit_batch(df.sparkSession, batch_id, path)


def commit_batch(spark: SparkSession, batch_id: int, path: str) -> None:
    write_text(spark, f"{path}/{COMMITS}/{batch_id}", "")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole micro-batches, ascending."""
    return sorted(int(n) for n in child_names(spark, f"{path}/{COMMITS}") if n.isdigit())


def read_committed(spark: SparkSession, path: str, schema: T.StructType, batches: Sequence[int] | None = None) -> DataFrame:
    """Rows of the whole micro-batches (or of some of them); a batch being written, or half written before a crash, is not read."""
    numbers = committed(spark, path) if batches is None else batches
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/batch={n}" for n in numbers])


def forget_batches(spark: SparkSession, path: str, batches: Sequence[int]) -> None:
    """Remove micro-batches that nothing reads any more: first their mark, then their rows."""
    for n in batches:
        delete_path(spark, f"{path}/{COMMITS}/{n}")
        delete_path(spark, f"{path}/batch={n}")


def drain(query) -> None:
    """Run until everything the sources have now is stored, in as many bounded micro-batches as that takes; then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str],
                 order: Sequence[str] = ()) -> DataFrame:
    """Current rows of an upsert log: per key the last batch wins, within it the last ``order``."""
    rows = spark.read.parquet(path)
    return latest_write(rows, list(keys), ["batch", *order] if order else "batch").drop("batch")


def compact_upserts(spark: SparkSession, path: str, target: str, keys: Sequence[str],
                    order: Sequence[str] = ()) -> None:
    """Resolve the log into a new log that starts with one batch."""
    rows = read_upserts(spark, path, keys, order)
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{target}/batch=-1")

