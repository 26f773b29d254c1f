"""Table jobs and streaming queries: reruns, late and repeated rows, restarts and timeouts."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tickloom.plans import jobs as J, serving as P
from tickloom.schemas import DAY_MS, KLINE
from tickloom.session import fresh_dir, shared_dir
from tickloom.sources import lake, sinks, topics
from tickloom.streaming import queries as Q
from tickloom.streaming.feed import later_rows, time_ordered

from .conftest import as_dicts

T0 = 1_700_006_400_000  # midnight UTC


def klines(spark, starts, interval="1m", closed=True, symbol="AUSDT", close=1.0):
    rows = [(t, symbol, t, t + 59_999, interval, close, close + 1, close - 1, close, 1.0, 1.0, 1, closed) for t in starts]
    return spark.createDataFrame(rows, KLINE)


def stored(spark, df):
    path = fresh_dir(spark, "test-klines")
    lake.append_sorted(df, path, "kline_start", lake.SORT_ORDER["kline"])
    return path


def test_shared_dir_follows_the_session(spark):
    assert fresh_dir(spark, "x").startswith(shared_dir(spark)) and fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="shared folder"):
        shared_dir(Session())


def test_compaction_sizes_by_all_bytes(spark):
    path = fresh_dir(spark, "test-compact-big")
    big = lake.with_day(klines(spark, [T0 + i * 1000 for i in range(60_000)], interval="1s"), "kline_start").withColumn("close", F.rand(3)).withColumn("high", F.rand(4))
    big.coalesce(1).write.partitionBy("dt").parquet(path)
    for i in range(6):
        lake.with_day(klines(spark, [T0 + i]), "kline_start").coalesce(1).write.mode("append").partitionBy("dt").parquet(path)
    J.compact(spark, path, target_bytes=200_000)
    files = lake.data_files(spark, path).select("bytes").collect()
    assert len(files) > 3 and max(r["bytes"] for r in files) < 600_000
    assert spark.read.parquet(path).count() == 60_006


def test_retention_drops_rewrites_and_leaves_days(spark):
    minutes = klines(spark, [T0 + d * DAY_MS + h * 3_600_000 for d in range(4) for h in range(24)])
    keep = klines(spark, [T0 + DAY_MS], interval="1h").unionByName(klines(spark, [T0 + DAY_MS + 60_000], closed=False))
    path = stored(spark, minutes.unionByName(keep))
    done = J.apply_retention(spark, path, T0 + 3 * DAY_MS + 12 * 3_600_000, days=1)
    left = spark.read.parquet(path)
    assert done == {"days_rewritten": 2, "days_dropped": 1, "rows_deleted": 60}
    assert left.filter("interval = '1m' AND is_closed").agg(F.min("kline_start")).first()[0] == T0 + 2 * DAY_MS + 12 * 3_600_000
    assert left.count() == 36 + 2
    # Less than a day is treated as one day, so a rerun deletes nothing more.
    assert J.apply_retention(spark, path, T0 + 3 * DAY_MS + 12 * 3_600_000, days=0)["rows_deleted"] == 0


def test_compaction_merges_files_and_keeps_rows(spark):
    path = fresh_dir(spark, "test-compact")
    lake.with_day(klines(spark, [T0 + i * 60_000 for i in range(1000)]), "kline_start").repartition(7).write.partitionBy("dt").parquet(path)
    lake.with_day(klines(spark, [T0 + 2 * DAY_MS + i * 60_000 for i in range(10)]), "kline_start").coalesce(1).write.mode("append").partitionBy("dt").parquet(path)
    before = lake.data_files(spark, path).groupBy("dt").count().collect()
    assert J.compact(spark, path) == 1
    after = {str(r["dt"]): r["count"] for r in lake.data_files(spark, path).groupBy("dt").count().collect()}
    assert max(r["count"] for r in before) == 7 and set(after.values()) == {1}
    assert spark.read.parquet(path).select("kline_start").distinct().count() == 1010
    assert J.compact(spark, path) == 0


def named_files(spark, path):
    return {(str(r["dt"]), r["path"].rsplit("/", 1)[1]): r["bytes"] for r in lake.data_files(spark, path).collect()}


def test_compaction_leaves_files_near_the_target_alone(spark):
    path, day = fresh_dir(spark, "test-binpack"), 86_400_000
    noisy = klines(spark, [T0 + i * 1000 for i in range(8_000)], interval="1s").withColumn("close", F.rand(3)).withColumn("high", F.rand(4))
    lake.with_day(noisy, "kline_start").coalesce(1).write.partitionBy("dt").parquet(path)
    (big,) = named_files(spark, path).items()
    for i in range(9):
        lake.with_day(klines(spark, [T0 + i, T0 + 3 * day + i]), "kline_start").coalesce(1).write.mode("append").partitionBy("dt").parquet(path)
    for i in range(3):
        lake.with_day(klines(spark, [T0 + 7 * day + i]), "kline_start").coalesce(1).write.mode("append").partitionBy("dt").parquet(path)
    before, rows = named_files(spark, path), sorted(map(tuple, spark.read.parquet(path).collect()), key=str)
    small = max(size for key, size in before.items() if key != big[0])
    assert J.compact(spark, path, target_bytes=max(big[1], 4 * small)) == 2
    after = named_files(spark, path)
    # The large file keeps its name, three files are too few, two days have one file in the place of nine.
    assert after[big[0]] == big[1] and len(after) == 1 + 1 + 1 + 3
    assert {k for k in after if k in before} == {big[0], *(k for k in before if k[0] == max(before)[0])}
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == rows
    assert J.compact(spark, path, target_bytes=max(big[1], 4 * small)) == 0 and named_files(spark, path) == after


def test_groups_of_files_stay_below_the_target():
    sizes = {f"f{i}": 10 + i * 37 % 90 for i in range(50)}
    groups = J.pack_files(sizes, 100)
    assert sorted(f for g in groups for f in g) == sorted(sizes) and max(sum(sizes[f] for f in g) for g in groups) <= 100
    assert len(groups) <= 1.23 * -(-sum(sizes.values()) // 100) + 1


@pytest.mark.parametrize("broken", ["write_text", "delete_path"])
def test_a_compaction_that_breaks_off_is_completed_or_forgotten(spark, monkeypatch, broken):
    path = fresh_dir(spark, "test-broken-compaction")
    for i in range(6):
        lake.with_day(klines(spark, [T0 + i]), "kline_start").coalesce(1).write.mode("append").partitionBy("dt").parquet(path)
    real, calls = getattr(J, broken), []

    def fail(*args):
        calls.append(args)
        if len(calls) == (1 if broken == "write_text" else 3):
            raise OSError("gone")
        return real(*args)
    monkeypatch.setattr(J, broken, fail)
    with pytest.raises(OSError, match="gone"):
        J.compact(spark, path)
    monkeypatch.undo()
    J.finish_compaction(spark, path)
    assert spark.read.parquet(path).count() == 6
    assert len(named_files(spark, path)) == (6 if broken == "write_text" else 1)
    J.compact(spark, path)
    assert spark.read.parquet(path).count() == 6 and len(named_files(spark, path)) == 1
    assert not [n for n in lake.child_names(spark, path) if n.startswith(J.ASIDE)]


def test_import_is_idempotent_and_stops_at_the_last_whole_minute(spark):
    source = klines(spark, [T0 + i * 60_000 for i in range(10)])
    symbols = spark.createDataFrame([("AUSDT",), ("NEWUSDT",)], "symbol string")
    path = fresh_dir(spark, "test-import")
    now = T0 + 5 * 60_000 + 30_000
    J.import_klines(spark, symbols, source, path, now, full=True)
    assert spark.read.parquet(path).count() == 5
    for _ in range(2):
        J.import_klines(spark, symbols, source, path, now + 120_000)
    assert sorted(r["kline_start"] for r in spark.read.parquet(path).collect()) == [T0 + i * 60_000 for i in range(7)]


def test_day_filter_prunes_partitions_and_reaches_the_scan(spark):
    path = stored(spark, klines(spark, [T0 + d * DAY_MS for d in range(5)]))
    df = P.in_range(spark.read.parquet(path), T0 + DAY_MS, T0 + 3 * DAY_MS, "kline_start")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 2 and "PartitionFilters: [isnotnull(dt" in plan
    assert "GreaterThanOrEqual(kline_start" in plan and "LessThan(kline_start" in plan


def test_gap_backfill_points(spark):
    ticks = spark.createDataFrame([("AUSDT", T0, 1.0, 1), ("AUSDT", T0 + 1_200_000, 1.0, 2)], "symbol string, event_time long, price double, seq long")
    history = klines(spark, [T0 + i * 60_000 for i in range(40)], close=2.0)
    points = J.backfill_points(ticks, history, T0 + 2_000_000)
    times = sorted(r["time"] for r in as_dicts(points))
    # From a minute after the last live point up to the end of the gap, both inclusive.
    assert times[0] == T0 + 120_000 and times[-1] == T0 + 1_260_000 and len(times) == 20


def ticks(spark, rows):
    return spark.createDataFrame(rows, "symbol string, event_time long, price double, volume double, seq long")


def run_files(spark, frames, build, **options):
    """One micro-batch per frame, in order, on one checkpoint (a restart before each)."""
    src, out, state = (fresh_dir(spark, f"test-{n}") for n in ("src", "out", "state"))
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(src)
        stream = topics.read_files_as_topic(spark, src, frame.schema, files_per_trigger=100)
        sinks.append_stream(build(stream), out, state, once=True, **options).awaitTermination()
    return spark.read.parquet(out)


def test_windows_drop_late_rows_and_keep_out_of_order_ones(spark):
    minute = 60_000
    frames = [ticks(spark, [("A", T0 + 10_000, 1.0, 1.0, 1), ("A", T0 + 5 * minute, 2.0, 1.0, 3)]),
              ticks(spark, [("A", T0 + 4 * minute, 9.0, 1.0, 2)]),           # late by a minute: kept
              ticks(spark, [("A", T0 + 30 * minute, 3.0, 1.0, 4)]),
              ticks(spark, [("A", T0 + 10_500, 7.0, 1.0, 5), ("A", T0 + 60 * minute, 4.0, 1.0, 6)])]  # beyond the watermark: dropped
    out = {r["open_time"]: r for r in as_dicts(run_files(spark, frames, lambda s: Q.window_candles(s, "1 minute")))}
    assert sorted(out) == [T0, T0 + 4 * minute, T0 + 5 * minute, T0 + 30 * minute]
    assert out[T0]["high"] == 1.0 and out[T0 + 4 * minute]["close"] == 9.0


def test_repeated_file_is_deduplicated(spark):
    rows = klines(spark, [T0 + i * 60_000 for i in range(5)])
    again = klines(spark, [T0 + 4 * 60_000, T0 + 5 * 60_000])
    out = run_files(spark, [rows, again], Q.dedup_kline_stream)
    assert sorted(r["kline_start"] for r in out.collect()) == [T0 + i * 60_000 for i in range(6)]


def test_roll_up_stream_equals_batch(spark):
    seconds = klines(spark, [T0 + i * 1000 for i in range(0, 200, 3)], interval="1s")
    flush = klines(spark, [T0 + 3_600_000, T0 + 7_200_000], interval="1s")
    out = run_files(spark, [seconds.unionByName(seconds.limit(5)), flush], Q.roll_up_stream)
    from tickloom.operators.candles import roll_up_seconds
    pick = ("kline_start", "open", "high", "low", "close", "volume", "trade_count", "kline_close")
    want = sorted(tuple(r) for r in roll_up_seconds(seconds).select(*pick).collect())
    assert sorted(tuple(r) for r in out.select(*pick).filter(f"kline_start < {T0 + 3_600_000}").collect()) == want


def test_idle_symbol_is_flushed_by_the_timeout(spark):
    src, state = fresh_dir(spark, "test-idle-src"), fresh_dir(spark, "test-idle-state")
    klines(spark, [T0 + 2_000, T0 + 3_000], interval="1s", close=5.0).write.parquet(src)
    stream = topics.read_files_as_topic(spark, src, KLINE)
    q = (Q.filled_roll_up_stream(stream, idle_ms=1000).writeStream.format("memory").queryName("idle_minutes")
         .outputMode("append").option("checkpointLocation", state).trigger(processingTime="1 second").start())
    try:
        deadline, rows = time.time() + 60, []
        while not rows and time.time() < deadline:
            time.sleep(1)
            rows = spark.sql("SELECT * FROM idle_minutes").collect()
    finally:
        q.stop()
    (row,) = rows
    assert (row["kline_start"], row["kline_close"], row["open"], row["real_count"]) == (T0, T0 + 59_999, 5.0, 2)


def test_upsert_log_survives_a_repeated_batch(spark):
    path = fresh_dir(spark, "test-upserts")
    schema = "symbol string, open_time long, close double"
    sinks.write_batch(spark.createDataFrame([("A", 1, 1.0), ("A", 2, 1.0)], schema), 0, path)
    for _ in range(2):
        sinks.write_batch(spark.createDataFrame([("A", 2, 2.0), ("A", 3, 3.0)], schema), 1, path)
    keys = ["symbol", "open_time"]
    want = {(1, 1.0), (2, 2.0), (3, 3.0)}
    assert {(r["open_time"], r["close"]) for r in sinks.read_upserts(spark, path, keys).collect()} == want
    target = fresh_dir(spark, "test-compacted-upserts")
    sinks.compact_upserts(spark, path, target, keys)
    assert {(r["open_time"], r["close"]) for r in sinks.read_upserts(spark, target, keys).collect()} == want


def test_feed_follows_time_whatever_the_files(spark):
    seen = []
    df = ticks(spark, [("A", T0 + i * 60_000, float(i), 1.0, i) for i in range(100)]).repartition(7, F.hash("seq"))
    stream = time_ordered(df, "event_time", "test-feed", files=4, flush=later_rows(df, "event_time", 86_400_000, "symbol"))
    sinks.foreach_batch(stream, lambda b, i: seen.append(sorted(r["seq"] for r in b.collect())),
                        fresh_dir(spark, "test-feed-state"), once=True).awaitTermination()
    assert len(seen) == 5 and [x for s in seen for x in s] == [*range(100), 99]


def test_windows_of_a_table_in_many_mixed_files_are_complete(spark):
    df = ticks(spark, [("A", T0 + i * 60_000, float(i), 1.0, i) for i in range(100)]).repartition(7, F.hash("seq"))
    stream = time_ordered(df, "event_time", "test-mixed", files=4, flush=later_rows(df, "event_time", 86_400_000))
    out = fresh_dir(spark, "test-mixed")
    sinks.append_stream(Q.window_candles(stream, "1 minute"), out, fresh_dir(spark, "test-mixed-state"), once=True).awaitTermination()
    assert spark.read.parquet(out).count() == 100


def test_run_all_passes_on_the_error_of_a_query(spark):
    src = fresh_dir(spark, "test-fail")
    klines(spark, [T0]).write.parquet(src)
    stream = topics.read_files_as_topic(spark, src, KLINE)

    def fail(batch, batch_id):
        raise RuntimeError("sink is down")
    spark.streams.resetTerminated()
    sinks.foreach_batch(stream, fail, fresh_dir(spark, "test-fail-state"))
    with pytest.raises(Exception, match="sink is down"):
        Q.run_all(spark)
    spark.streams.resetTerminated()
