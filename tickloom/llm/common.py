"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_dir

#: The white space of a word boundary: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch: of whole texts, and of a few numbers.
TEXT_ROWS, NARROW_ROWS = 1000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver collects its garbage: for tables read again from their files."""
    former = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, former)


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``narrow`` tells that only rows of a few numbers go to Python in it, which may travel in large batches.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    schema = df.schema
    spark.conf.set(_BATCH, str(NARROW_ROWS if narrow else TEXT_ROWS))
    try:
        with shuffles_dropped(spark):
            df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, str(TEXT_ROWS))
    return spark.read.schema(schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bound the rows of an Arrow batch for what runs inside; the former bound comes back."""
    former = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, former)


def store(df: DataFrame, label: str, rows: int, by: str | None = None) -> DataFrame:
    """``materialize`` for wide rows: ``rows`` of them to an Arrow batch; in a folder for each value of the column ``by``."""
    path, schema = fresh_dir(df.sparkSession, label), df.schema
    with arrow_rows(df.sparkSession, rows), shuffles_dropped(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the folder of a table of ``store`` that nothing reads any more, or only the folder ``part`` in it."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/tickloom/" in folder and folder.endswith(part):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to Python."""
    spark.conf.set(_BATCH, str(TEXT_ROWS))


def words_of(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
