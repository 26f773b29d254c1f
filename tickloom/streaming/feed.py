"""A table as a stream: written once in time order, then read in bounded micro-batches.

However the table's own files are laid out, the files of the feed each hold one stretch of time, and their
modification times follow it, which is the order a file source reads in. So a watermark drops only what is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_dir
from ..sources.topics import read_files_as_topic

FILES = 8


def stamp_in_order(spark: SparkSession, path: str) -> None:
    """Give the data files of a folder ascending modification times in the order of their names (a part has its number)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s.getPath().getName(), s) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet"))
    start = min((s.getModificationTime() for _, s in files), default=0) - len(files)
    for at, (_, status) in enumerate(files):
        fs.setTimes(status.getPath(), start + at, -1)


def time_ordered(df: DataFrame, time: str, label: str, files: int = FILES, flush: DataFrame | None = None,
                 files_per_trigger: int = 1) -> DataFrame:
    """Stream of ``df`` in the order of ``time``, about ``files`` files.

    ``flush`` holds rows to append after everything else: later than all rows, they move the watermark on and
    close what is still open.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, f"{label}-in")
    df.repartitionByRange(files, time).sortWithinPartitions(time).write.parquet(path)
    stamp_in_order(spark, path)
    if flush is not None:
        flush.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return read_files_as_topic(spark, path, df.schema, files_per_trigger=files_per_trigger)


def later_rows(df: DataFrame, time: str, by_ms: int, *keys: str) -> DataFrame:
    """For each key (or for all rows) a copy of its last row, ``by_ms`` after the last row of the table."""
    end = df.agg((F.max(time) + by_ms).alias("_end"))
    rest = [c for c in df.columns if c != time and c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), time).alias("_row")) if keys else \
        df.agg(F.max_by(F.struct(*rest), time).alias("_row"))
    return last.select(*keys, "_row.*").join(F.broadcast(end)).withColumnRenamed("_end", time)
