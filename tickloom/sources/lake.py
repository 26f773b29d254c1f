"""Day-partitioned Parquet tables: create, sorted append, read, and file listing."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import ms_to_timestamp
from ..schemas import DAY_MS, TARGET_FILE_BYTES

# Event-time column of each table kind: it gives the partition date.
TABLE_TIME = {"ticker": "event_time", "trade": "trade_time", "kline": "kline_start"}
SORT_ORDER = {"ticker": ("symbol", "event_time"), "trade": ("symbol", "trade_time"),
              "kline": ("symbol", "kline_start")}


def read_records(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read with a declared schema; nothing is inferred and unlisted columns are not read."""
    return spark.read.schema(schema).format(fmt).load(path)


def with_day(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("dt", F.to_date(ms_to_timestamp(time)))


def with_ingest_columns(df: DataFrame, kind: str) -> DataFrame:
    """Timestamps a stored record carries next to its millisecond columns."""
    names = {"ticker": {"event_timestamp": "event_time"},
             "trade": {"event_timestamp": "event_time", "trade_timestamp": "trade_time"},
             "kline": {"kline_timestamp": "kline_start"}}[kind]
    for name, source in names.items():
        df = df.withColumn(name, ms_to_timestamp(source))
    return df.withColumn("ingested_at", F.current_timestamp())


def _writer(df: DataFrame, mode: str):
    return (df.write.mode(mode).partitionBy("dt").option("compression", "zstd")
            .option("parquet.block.size", TARGET_FILE_BYTES))


def append_sorted(df: DataFrame, path: str, time: str, sort: Sequence[str], mode: str = "append") -> None:
    """Write day partitions clustered by ``sort``.

    Range partitioning by (day, sort) gives each task one contiguous stretch: few files per day,
    and neither a hot day nor a hot symbol ends up in one task.
    """
    dated = with_day(df, time)
    _writer(dated.repartitionByRange("dt", *sort).sortWithinPartitions("dt", *sort), mode).save(path)


def overwrite_days(df: DataFrame, path: str) -> None:
    """Replace exactly the day partitions present in ``df`` (which may be read from ``path``)."""
    _writer(df, "overwrite").option("partitionOverwriteMode", "dynamic").save(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(target) and bool(fs.listStatus(target))


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    fs, target = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def move_file(spark: SparkSession, old: str, new: str) -> None:
    fs, target = _hadoop(spark, old)
    if not fs.rename(target, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot move {old} to {new}")


def delete_path(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; one of the same name is replaced."""
    fs, target = _hadoop(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = fs.create(draft, True)
    out.write(text.encode())
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _hadoop(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def table_days(spark: SparkSession, path: str) -> list[int]:
    """The days of a table in ms, ascending, from its folder names alone."""
    names = [n for n in child_names(spark, path) if re.fullmatch(r"dt=\d{4}-\d\d-\d\d", n)]
    return [(date.fromisoformat(n[3:]) - date(1970, 1, 1)).days * DAY_MS for n in names]


def drop_days(spark: SparkSession, path: str, days: Sequence[str]) -> None:
    """Remove whole day partitions of a table."""
    for day in days:
        delete_path(spark, f"{path}/dt={day}")


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """(dt, path, bytes) of the table's data files, from a listing that reads no content."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(path).select("path", "length"))
    day = F.regexp_extract("path", r"/dt=(\d{4}-\d{2}-\d{2})/", 1)
    return files.select(F.to_date(day).alias("dt"), "path", F.col("length").alias("bytes"))
