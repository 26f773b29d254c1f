"""Reading only as much as is asked for: backward pages of a day-partitioned series, and one page of a sorted list."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import bucket
from ..operators.merge import priority_merge
from ..operators.sizing import small_side
from ..schemas import DAY_MS
from ..session import fresh_dir
from .serving import in_range

#: Up to so many symbols become a pushed list, which skips row groups; more are joined.
LISTED_SYMBOLS = 200


def tiered_reader(hot: DataFrame, cold: DataFrame, cutoff_ms: int) -> Callable[[int, int], DataFrame]:
    """Rows of ``[lo, hi)``: the hot tier from the cutoff on, the cold tier before it."""
    def read(lo: int, hi: int) -> DataFrame:
        tiers = [in_range(cold, lo, min(hi, cutoff_ms))] if lo < cutoff_ms else []
        if hi > cutoff_ms:
            tiers.append(in_range(hot, max(lo, cutoff_ms), hi))
        return priority_merge(*tiers)
    return read


def _of(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    if n <= LISTED_SYMBOLS:
        return rows.filter(F.col("symbol").isin([r["symbol"] for r in wanted.select("symbol").collect()]))
    return rows.join(F.broadcast(wanted) if n <= 500_000 else wanted, "symbol", "left_semi")


def paged_minutes(read: Callable[[int, int], DataFrame], symbols: DataFrame, step_ms: int, limit: int, end_ms: int, first_ms: int,
                  page_ms: int = DAY_MS, pages: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """The rows before ``end_ms`` from which the newest ``limit`` bars of every symbol can be built, read backwards page by page.

    The newest page is read first. Only symbols that still lack bars go on to the next, older one, which is twice as long, until
    none is left or ``first_ms`` is reached. Pages begin at bar borders, so no bar is cut in two. Counting reads symbol and time
    alone, and what is carried from page to page is one row per unfinished symbol. ``pages`` is filled with (from, to,
    symbols) of what was read.
    """
    left = small_side(symbols.select("symbol").distinct().withColumn("need", F.lit(limit).cast("long")))
    n, hi, parts = left.count(), end_ms, []
    while n and hi > first_ms:
        lo = max(0, (hi - max(page_ms, step_ms)) // step_ms * step_ms)
        parts.append(_of(read(lo, hi), left, n))
        if pages is not None:
            pages.append((lo, hi, n))
        found = parts[-1].groupBy("symbol").agg(F.count_distinct(bucket("open_time", step_ms)).alias("found"))
        left = small_side(left.join(found, "symbol", "left").withColumn("need", F.col("need") - F.coalesce("found", F.lit(0)))
                          .filter("need > 0").drop("found"))
        n, hi, page_ms = left.count(), lo, page_ms * 2
    return reduce(DataFrame.unionByName, parts) if parts else read(end_ms, end_ms)


def page(df: DataFrame, order: Sequence[str], number: int, size: int = 10) -> DataFrame:
    """One page of a sorted list; the page number is clamped to the pages there are.

    The list is written once in ranges of the order; their row counts tell which one or two hold the page, and only these are
    sorted out. Rows equal in ``order`` follow a hash of the whole row, so a page is the same in every run and equal rows
    spread over ranges.
    """
    spark: SparkSession = df.sparkSession
    path = fresh_dir(spark, "sorted-list")
    rows = df.withColumn("_tie", F.xxhash64(*df.columns))
    keys = [*order, "_tie"]
    (rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
     .write.partitionBy("_range").parquet(path))
    stored = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _range int").parquet(path)
    counts = sorted((r["_range"], r["count"]) for r in stored.groupBy("_range").count().collect())
    total = sum(n for _, n in counts)
    at = (min(max(number, 1), max((total + size - 1) // size, 1)) - 1) * size
    before, held = 0, []
    for k, n in counts:
        if before < at + size and before + n > at:
            held.append((k, before))
        before += n
    if not held:
        return df.limit(0)
    starts = F.create_map(*[F.lit(x) for pair in held for x in pair])
    # Ranges are pruned as partitions; each is numbered by itself and its start added.
    place = F.row_number().over(W.partitionBy("_range").orderBy(*keys)) + starts[F.col("_range")]
    picked = stored.filter(F.col("_range").isin([k for k, _ in held])).withColumn("_place", place)
    return picked.filter((F.col("_place") > at) & (F.col("_place") <= at + size)).orderBy("_place").select(*df.columns)
