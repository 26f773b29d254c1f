"""Backward pages and pages of sorted lists read what is asked for, and nothing else."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators.candles import resample
from tickloom.operators.merge import newest_n
from tickloom.plans import paging
from tickloom.schemas import DAY_MS, HOUR_MS, MINUTE_MS
from tickloom.session import fresh_dir
from tickloom.sources import lake

from .conftest import as_dicts

T0 = 1_700_006_400_000  # midnight UTC


SCHEMA = "symbol string, open_time long, open double, high double, low double, close double, volume double, dt date"


def minutes(spark, symbol, first_day, days, every):
    rows = spark.range(0, days * 1440, every).select(F.lit(symbol).alias("symbol"), (F.lit(T0 + first_day * DAY_MS) + F.col("id") * MINUTE_MS).alias("open_time"))
    return rows.select("*", *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")), F.lit(2.0).alias("volume"))


def scribble(spark, path, day):
    """Make the files of a day unreadable."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dt={day}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        out = fs.create(status.getPath(), True)
        out.write(b"no table " * 100)
        out.close()


@pytest.fixture(scope="module")
def table(spark):
    path = fresh_dir(spark, "test-pages")
    rows = minutes(spark, "BUSY", 0, 40, 5).unionByName(minutes(spark, "QUIET", 20, 15, 60)).unionByName(minutes(spark, "RARE", 0, 40, 1440))
    lake.append_sorted(rows, path, "open_time", ("symbol", "open_time"))
    return path


def ask(spark, path, names, step, limit, **options):
    df, pages = spark.read.schema(SCHEMA).parquet(path), []
    symbols = spark.createDataFrame([(n,) for n in names], "symbol string")
    rows = paging.paged_minutes(paging.tiered_reader(df, df, T0 + 30 * DAY_MS), symbols, step, limit, T0 + 40 * DAY_MS, lake.table_days(spark, path)[0],
                                pages=pages, **options)
    return as_dicts(newest_n(resample(rows.drop("dt"), step), limit).orderBy("symbol", "open_time")), pages


@pytest.mark.parametrize("names, step, limit", [(["BUSY"], HOUR_MS, 30), (["BUSY", "QUIET", "RARE", "NONE"], HOUR_MS, 50), (["RARE"], 7 * DAY_MS, 3),
                                                (["QUIET", "BUSY"], 4 * HOUR_MS, 1000), (["NONE"], HOUR_MS, 1), (["BUSY"], MINUTE_MS, 10)])
def test_pages_give_the_bars_of_the_whole_table(spark, table, names, step, limit):
    got, _ = ask(spark, table, names, step, limit)
    whole = spark.read.parquet(table).drop("dt").filter(F.col("symbol").isin(names))
    assert got == as_dicts(newest_n(resample(whole, step), limit).orderBy("symbol", "open_time"))


def test_only_symbols_that_lack_bars_go_on_and_old_days_stay_unread(spark, table):
    path = fresh_dir(spark, "test-pages-broken")
    spark.read.parquet(table).write.partitionBy("dt").parquet(path)
    days = sorted(r["dt"] for r in spark.read.parquet(path).select(F.col("dt").cast("string").alias("dt")).distinct().collect())
    for day in days[:30]:
        scribble(spark, path, day)
    got, pages = ask(spark, path, ["BUSY", "QUIET"], HOUR_MS, 20)
    assert len(got) == 40 and [(lo - T0) // DAY_MS for lo, _, _ in pages] == [39, 37, 33] and [n for *_, n in pages] == [2, 1, 1]
    with pytest.raises(Exception):
        ask(spark, path, ["RARE"], HOUR_MS, 20)


def test_many_symbols_are_joined_instead_of_listed(spark, table, monkeypatch):
    want = ask(spark, table, ["BUSY", "QUIET"], HOUR_MS, 30)
    monkeypatch.setattr(paging, "LISTED_SYMBOLS", 0)
    assert ask(spark, table, ["BUSY", "QUIET"], HOUR_MS, 30) == want


@pytest.mark.parametrize("number", [1, 2, 50, 99, 100, 101, 10_000, 0, -3])
def test_page_of_a_sorted_list(spark, number):
    rows = spark.range(0, 1005).select(F.concat(F.lit("S"), F.lpad((F.col("id") * 7 % 1005).cast("string"), 5, "0")).alias("symbol"), F.col("id").alias("n")).repartition(6)
    want = sorted(r["symbol"] for r in rows.collect())
    at = min(max(number, 1), 101)
    assert [r["symbol"] for r in paging.page(rows, ["symbol"], number).collect()] == want[(at - 1) * 10:at * 10]


def test_pages_of_ties_cover_the_list_once(spark):
    rows = spark.range(0, 95).select(F.lit("same").alias("symbol"), F.col("id").alias("n"), F.lit(None).cast("string").alias("x"))
    pages = [[r["n"] for r in paging.page(rows, ["symbol"], k).collect()] for k in range(1, 11)]
    assert sorted(n for p in pages for n in p) == list(range(95))
    assert paging.page(rows.limit(0), ["symbol"], 3).count() == 0


def test_the_last_page_sorts_no_list_in_one_task(spark):
    rows = spark.range(0, 50_000).select(F.col("id").cast("string").alias("symbol"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        last = paging.page(rows, ["symbol"], 10 ** 9)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = last._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan
    pruned = re.search(r"PartitionFilters: \[[^\]]*_range#\d+ = (\d+)", plan)
    assert int(pruned[1]) >= 1
    assert [r["symbol"] for r in last.collect()] == sorted(str(i) for i in range(50_000))[-10:]
