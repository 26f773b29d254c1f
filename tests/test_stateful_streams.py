"""Timers, expiry and restarts of the stateful minutes, and the message log as a source."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tickloom.schemas import DAY_MS, KLINE, MINUTE_MS
from tickloom.session import fresh_dir
from tickloom.sources import sinks, topic_log, topics
from tickloom.streaming import minutes as M
from tickloom.streaming.feed import stamp_in_order

T0 = 1_700_000_040_000 // MINUTE_MS * MINUTE_MS


def seconds(spark, rows):
    """(symbol, ms after T0, close[, volume]) as one-second klines of one price."""
    full = [(T0 + at + 999, s, T0 + at, T0 + at + 999, "1s", c, c, c, c, float(v[0]) if v else 1.0, 2.0, 3, True) for s, at, c, *v in rows]
    return spark.createDataFrame(full, KLINE)


class Feed:
    """A folder of files read one by one, and a sink that goes on from its checkpoint."""

    def __init__(self, spark, **options):
        self.spark, self.options, self.n = spark, options, 0
        self.source, self.out, self.state = (fresh_dir(spark, f"test-feed-{x}") for x in ("src", "out", "state"))

    def add(self, *rows):
        path = fresh_dir(self.spark, "test-feed-part")
        seconds(self.spark, rows).coalesce(1).write.parquet(path)
        jvm, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        fs = jvm.Path(self.source).getFileSystem(conf)
        fs.mkdirs(jvm.Path(self.source))
        (part,) = [s.getPath() for s in fs.listStatus(jvm.Path(path)) if s.getPath().getName().endswith(".parquet")]
        fs.rename(part, jvm.Path(f"{self.source}/{self.n:05d}.parquet"))
        self.n += 1
        stamp_in_order(self.spark, self.source)
        return self

    def run(self):
        stream = M.idle_roll_up_stream(topics.read_files_as_topic(self.spark, self.source, KLINE), **self.options)
        sinks.append_stream(stream, self.out, self.state, once=True).awaitTermination()
        return {(r["symbol"], (r["kline_start"] - T0) // 1000): r for r in self.spark.read.schema(stream.schema).parquet(self.out).collect()}


def test_a_silent_symbol_is_flushed_by_its_timer(spark):
    feed = Feed(spark)
    feed.add(("A", 0, 1.0), ("A", 30_000, 5.0), ("A", 31_000, 3.0, 0), ("B", 1_000, 9.0))
    out = feed.run()
    assert out == {}
    # B goes on; A's minute is closed 65 s of event time after it opened, without another row of A.
    feed.add(("B", 25_000, 8.0), ("B", 90_000, 7.0)).add(("B", 91_000, 6.0))
    out = feed.run()
    assert set(out) == {("A", 0), ("B", 0)}
    a = out["A", 0]
    assert (a["open"], a["high"], a["low"], a["close"], a["volume"], a["trade_count"], a["real_count"]) == (1.0, 5.0, 1.0, 3.0, 2.0, 9, 2)
    assert (out["B", 0]["open"], out["B", 0]["close"]) == (9.0, 8.0)


def test_repeats_replace_and_late_seconds_are_dropped(spark):
    feed = Feed(spark)
    feed.add(("A", 10_000, 1.0), ("A", 11_000, 2.0)).add(("A", 11_000, 4.0), ("A", 9_000, 3.0))
    feed.add(("A", 60_000, 7.0)).add(("A", 12_000, 99.0), ("A", 61_000, 8.0)).add(("A", 200_000, 5.0)).add((None, 400_000, 0.0))
    out = feed.run()
    # The first minute began silent: its open is its first close, as nothing came before.
    assert [(k[1], r["open"], r["high"], r["low"], r["close"], r["real_count"]) for k, r in sorted(out.items())] == [
        (0, 3.0, 4.0, 1.0, 4.0, 3), (60, 7.0, 8.0, 7.0, 8.0, 2), (180, 8.0, 8.0, 5.0, 5.0, 1)]


def test_a_restart_goes_on_with_the_open_minute(spark):
    rows = [("A", 1000 * i * 7, float(i % 11)) for i in range(60)] + [("B", 1000 * i * 13, float(i % 5)) for i in range(30)]
    rows.sort(key=lambda r: r[1])
    whole, parts = Feed(spark), Feed(spark)
    want = whole.add(*rows).add((None, 10 * DAY_MS, 0.0)).run()
    for k in range(0, len(rows), 17):
        parts.add(*rows[k:k + 17]).run()
    got = parts.add((None, 10 * DAY_MS, 0.0)).run()
    assert len(want) == 14 and got == want


def states(spark, feed, name):
    reader = spark.read.format("statestore").option("path", feed.state).option("stateVarName", name)
    return reader.load()


def test_state_of_silent_symbols_expires_on_the_event_clock(spark):
    feed = Feed(spark, keep_ms=10 * MINUTE_MS)
    feed.add(("A", 0, 1.0), ("B", 0, 1.0)).add(("B", 70_000, 2.0)).run()
    assert states(spark, feed, "opened").count() == 2
    feed.add(("B", 100_000, 2.0)).run()  # A is flushed and keeps its close
    assert {r["key"]["symbol"] for r in states(spark, feed, "closed").collect()} == {"A", "B"}
    assert {r["key"]["symbol"] for r in states(spark, feed, "opened").collect()} == {"B"}
    feed.add(("B", 14 * MINUTE_MS, 2.0)).add(("B", 14 * MINUTE_MS + 1000, 2.0)).run()
    assert {r["key"]["symbol"] for r in states(spark, feed, "closed").collect()} == {"B"}
    assert {r["key"]["symbol"] for r in states(spark, feed, "seconds").collect()} == {"B"}
    out = feed.add(("A", 15 * MINUTE_MS + 5000, 6.0), (None, 10 * DAY_MS, 0.0)).run()
    assert out["A", 900]["open"] == 6.0  # what came before is forgotten
    assert states(spark, feed, "closed").count() == 0


def test_timers_and_time_to_live_on_the_processing_clock(spark):
    feed = Feed(spark)
    feed.add(("A", 2_000, 5.0), ("A", 3_000, 6.0))
    stream = M.idle_roll_up_stream(topics.read_files_as_topic(spark, feed.source, KLINE), idle_ms=1000, keep_ms=4000, clock="processing")
    running = (stream.writeStream.format("memory").queryName("idle_by_wall_clock").outputMode("append")
               .option("checkpointLocation", feed.state).trigger(processingTime="1 second").start())
    try:
        deadline, rows, left = time.time() + 90, [], None
        while time.time() < deadline and not (rows and left == 0):
            time.sleep(1)
            rows = spark.sql("SELECT * FROM idle_by_wall_clock").collect()
            left = states(spark, feed, "closed").count() if rows else None
    finally:
        running.stop()
    (row,) = rows
    assert (row["kline_start"], row["close"], row["real_count"]) == (T0, 6.0, 2) and left == 0
    with pytest.raises(ValueError):
        M.idle_roll_up_stream(stream, clock="sundial")


# ------------------------------------------------------------------------------- message log

def messages(spark, n, start=0, keys=5):
    return spark.range(start, start + n).select(F.concat(F.lit("K"), F.col("id") % keys).alias("key"), F.col("id").cast("string").cast("binary").alias("value"),
                                                (F.lit(T0) + F.col("id") * 1000).alias("timestamp"), "id")


class LogRun:
    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options = spark, path, options
        self.out, self.state, self.progress = (fresh_dir(spark, f"test-log-{x}") for x in ("out", "state", "progress"))
        self.batches = []

    def run(self, fail_after=None):
        def write(batch, batch_id):
            if fail_after is not None and batch_id >= fail_after:
                raise RuntimeError("sink is down")
            self.batches.append(batch.count())
            sinks.write_batch(batch, batch_id, self.out)
        stream = topic_log.read_log(self.spark, self.path, self.progress, **self.options)
        running = sinks.foreach_batch(stream, write, self.state, trigger={"processingTime": "0 seconds"})
        sinks.drain(running)

    def got(self):
        rows = self.spark.read.parquet(self.out).collect() if any(self.batches) else []
        return sorted((r["partition"], r["offset"], r["key"], bytes(r["value"])) for r in rows)


@pytest.fixture
def log(spark):
    path = fresh_dir(spark, "test-log")
    ends = topic_log.append_log(messages(spark, 1000), path, ["timestamp", "id"], segment_rows=100)
    assert sum(ends.values()) == 1000 and topic_log.end_offsets(path) == (ends, (4, 100))
    return path


def test_offsets_are_dense_and_follow_time_within_a_partition(spark, log):
    more = topic_log.append_log(messages(spark, 300, 1000), log, ["timestamp", "id"], segment_rows=100)
    stored = spark.read.parquet(log).collect()
    for p, end in more.items():
        own = sorted((r["offset"], int(bytes(r["value"]))) for r in stored if r["partition"] == p)
        assert [o for o, _ in own] == list(range(end)) and [v for _, v in own] == sorted(v for _, v in own)
        assert all(r["segment"] == r["offset"] // 100 for r in stored if r["partition"] == p)
    assert len({(r["key"], r["partition"]) for r in stored}) == 5
    with pytest.raises(ValueError):
        topic_log.append_log(messages(spark, 1), log, ["timestamp", "id"], partitions=8, segment_rows=100)


def test_micro_batches_are_bounded_and_complete(spark, log):
    run = LogRun(spark, log, starting="earliest", max_offsets=130)
    run.run()
    assert sum(run.batches) == 1000 and max(run.batches) <= 130 and len(run.batches) >= 8
    assert len(set(run.got())) == 1000


def test_latest_start_sees_only_what_comes_later(spark, log):
    run = LogRun(spark, log, max_offsets=70)
    run.run()
    topic_log.append_log(messages(spark, 200, 1000), log, ["timestamp", "id"], segment_rows=100)
    run.run()
    assert sorted(int(v) for *_, v in run.got()) == list(range(1000, 1200)) and max(run.batches) <= 70


def test_restart_goes_on_from_the_committed_offsets(spark, log):
    run = LogRun(spark, log, starting="earliest", max_offsets=130)
    with pytest.raises(Exception, match="sink is down"):
        run.run(fail_after=3)
    assert sum(run.batches) < 1000
    topic_log.append_log(messages(spark, 50, 1000), log, ["timestamp", "id"], segment_rows=100)
    run.run()
    got = run.got()
    assert len(got) == len(set(got)) == 1050 and max(run.batches) <= 130
    run.run()  # nothing new
    assert run.got() == got


def test_a_progress_folder_of_another_query_is_refused(spark, log):
    run = LogRun(spark, log, starting="earliest", max_offsets=200)
    with pytest.raises(Exception, match="sink is down"):
        run.run(fail_after=2)
    got = run.got()
    run.progress = fresh_dir(spark, "test-log-progress")
    for _ in range(2):
        with pytest.raises(Exception, match="does not belong"):
            run.run()
    assert len(run.got()) >= len(got) and len(run.got()) == len(set(run.got()))


def test_gaps_after_retention_and_unfinished_appends(spark, log):
    ends, _ = topic_log.end_offsets(log)
    busy = max(ends, key=ends.get)
    topic_log.drop_segments(spark, log, {busy: 150})
    # Messages without a marker belong to an append that has not ended.
    spark.createDataFrame([(9_999, "K0", b"x", T0)], "offset long, key string, value binary, timestamp long").write.parquet(
        f"{log}/partition={busy}/segment=99")
    run = LogRun(spark, log, starting="earliest", max_offsets=10_000)
    run.run()
    assert len(run.got()) == 900 and min(o for p, o, *_ in run.got() if p == busy) == 100
    empty = LogRun(spark, fresh_dir(spark, "test-no-log"), starting="earliest")
    empty.run()
    assert empty.got() == []
