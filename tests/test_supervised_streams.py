"""Block-parallel streams with a hot symbol, whole micro-batches only, one fate for several queries, late rows counted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F, types as T

from tickloom.operators import indicators as I, throttle as H
from tickloom.schemas import KLINE, MINUTE_MS
from tickloom.session import fresh_dir
from tickloom.sources import sinks
from tickloom.streaming import blocks as B, queries as Q, supervision as V
from tickloom.streaming.feed import later_rows, time_ordered

T0 = 1_700_006_400_000


def hot_ticks(spark, n=4000):
    """Nine tenths of the ticks are of one symbol; prices repeat often."""
    i = F.col("id")
    return spark.range(n).select(F.when(i % 10 < 9, "HOT").otherwise(F.concat(F.lit("S"), i % 30)).alias("symbol"), (F.lit(T0) + i * 700).alias("event_time"),
                                 i.alias("seq"), F.when(i % 1000 == 17, F.lit(None)).otherwise(F.floor(i / 23) % 3).cast("double").alias("price"))


def in_blocks(spark, df, time, step, state_schema, schema, files=5):
    out, state = fresh_dir(spark, "test-blocks"), fresh_dir(spark, "test-blocks-carried")
    B.run_in_blocks(time_ordered(df, time, "test-blocks", files=files), step, state_schema, out, state, fresh_dir(spark, "test-blocks-state"), once=True).awaitTermination()
    return sinks.read_committed(spark, out, T.StructType.fromDDL(schema)), state


@pytest.mark.parametrize("block_ms", [60_000, 86_400_000])
def test_throttle_of_a_hot_symbol_equals_the_batch(spark, block_ms):
    ticks = hot_ticks(spark)
    got, state = in_blocks(spark, ticks, "event_time", B.throttle_step(5000, block_ms), B.THROTTLE_STATE,
                           "symbol string, seq bigint, event_time bigint, price double, reason string")
    want = H.sent_only(H.throttle(ticks, 5000)).select("symbol", "seq", "event_time", "price", "reason")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert len(sinks.committed(spark, state)) == B.KEPT_STATES + 1


def test_throttle_from_a_start_state(spark):
    ticks = spark.createDataFrame([("A", 10_000, 1, 5.0), ("A", 12_000, 2, 5.0), ("B", 9_000, 1, 7.0)], "symbol string, event_time long, seq long, price double")
    start = spark.createDataFrame([("A", 5.0, 6_000), ("C", 1.0, 0)], "symbol string, price double, sent_at long")
    out = {(r["symbol"], r["seq"]): r["reason"] for r in H.throttle(ticks, 5000, 60_000, start).collect()}
    assert out == {("A", 1): "skipped", ("A", 2): "heartbeat", ("B", 1): "change"}


def test_indicators_of_a_hot_symbol_equal_the_batch(spark):
    i = F.col("id")
    start, close = F.lit(T0) + i * MINUTE_MS, (100 + F.sin(i) * 7)
    rows = spark.range(1500).select(F.explode(F.when(i % 10 == 0, F.array(F.lit("HOT"), F.lit("S1"), F.lit("S2"))).otherwise(F.array(F.lit("HOT")))).alias("symbol"), "id")
    rows = rows.select(start.alias("event_time"), "symbol", start.alias("kline_start"), (start + 59_999).alias("kline_close"), F.lit("1m").alias("interval"),
                       *(close.alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"), F.lit(1.0).alias("quote_volume"),
                       F.lit(1).cast("long").alias("trade_count"), F.lit(True).alias("is_closed")).select(*KLINE.names)
    schema = "symbol string, timestamp bigint, sma20 double, sma50 double, ema12 double, ema26 double, close double"
    got, state = in_blocks(spark, rows, "kline_start", B.indicator_step(), B.INDICATOR_STATE, schema)
    key = lambda r: (r["symbol"], r["timestamp"])
    got, want = ({key(r): r for r in df.collect()} for df in (got, I.indicator_rows(rows, MINUTE_MS)))
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert [x is None for x in got[k]] == [x is None for x in r]
        assert [x or 0.0 for x in got[k][2:]] == pytest.approx([x or 0.0 for x in r[2:]], rel=1e-9)
    last = sinks.committed(spark, state)[-1:]
    carried = {r["symbol"]: r for r in sinks.read_committed(spark, state, T.StructType.fromDDL(B.INDICATOR_STATE), last).collect()}
    assert {s: len(r["closes"]) for s, r in carried.items()} == {"HOT": 49, "S1": 49, "S2": 49}


def test_a_repeated_micro_batch_starts_from_the_same_state(spark):
    ticks, out, state, checkpoint = hot_ticks(spark, 1000), *(fresh_dir(spark, f"test-repeat-{x}") for x in ("out", "state", "checkpoint"))
    stream, calls = time_ordered(ticks, "event_time", "test-repeat", files=4), []
    step = B.throttle_step(5000, 60_000)

    def breaks(rows, before):
        calls.append(before.count())
        results, after = step(rows, before)
        if len(calls) == 3:
            raise InterruptedError("gone")
        return results, after
    with pytest.raises(Exception, match="gone"):
        B.run_in_blocks(stream, breaks, B.THROTTLE_STATE, out, state, checkpoint, once=True).awaitTermination()
    B.run_in_blocks(stream, breaks, B.THROTTLE_STATE, out, state, checkpoint, once=True).awaitTermination()
    assert calls[2] == calls[3] and len(calls) == 5
    got = sinks.read_committed(spark, out, T.StructType.fromDDL("symbol string, seq bigint, event_time bigint, price double, reason string"))
    want = H.sent_only(H.throttle(ticks, 5000))
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in want.collect())


def test_half_written_micro_batches_are_not_read(spark):
    path, schema = fresh_dir(spark, "test-committed"), T.StructType.fromDDL("a long")
    assert sinks.read_committed(spark, path, schema).count() == 0
    for n in (0, 1, 2, 10):
        sinks.write_committed(spark.createDataFrame([(n,)], schema), n, path)
    sinks.write_batch(spark.createDataFrame([(99,)], schema), 3, path)
    sinks.write_committed(spark.createDataFrame([(5,)], schema), 1, path)
    assert sinks.committed(spark, path) == [0, 1, 2, 10]
    assert sorted(r["a"] for r in sinks.read_committed(spark, path, schema).collect()) == [0, 2, 5, 10]
    sinks.forget_batches(spark, path, [0, 10])
    assert sorted(r["a"] for r in sinks.read_committed(spark, path, schema).collect()) == [2, 5]


def ticks(spark, n, shift=0):
    return spark.range(n).select(F.lit("A").alias("symbol"), (F.lit(T0 + shift) + F.col("id") * 1000).alias("event_time"), F.col("id").alias("seq"), F.lit(1.0).alias("price"))


def test_one_failure_stops_the_siblings_and_passes_on_its_cause(spark):
    rows = ticks(spark, 200)
    started = {}

    def endless():
        started["good"] = sinks.append_stream(time_ordered(rows, "event_time", "test-good"), fresh_dir(spark, "test-good"), fresh_dir(spark, "test-good-state"))
        return started["good"]

    def fail(batch, batch_id):
        if batch_id == 1:
            raise RuntimeError("sink is down")
    broken = lambda: sinks.foreach_batch(time_ordered(rows, "event_time", "test-bad"), fail, fresh_dir(spark, "test-bad-state"), once=True)
    with pytest.raises(V.SupervisedFailure, match="(?s)query bad failed: .*sink is down") as caught:
        V.run_supervised(spark, {"good": endless, "bad": broken})
    assert caught.value.name == "bad" and not started["good"].isActive and started["good"].exception() is None
    spark.streams.resetTerminated()


def test_a_query_that_cannot_start_stops_those_that_did(spark):
    started = []

    def good():
        started.append(sinks.append_stream(time_ordered(ticks(spark, 50), "event_time", "test-first"), fresh_dir(spark, "test-first"), fresh_dir(spark, "test-first-state")))
        return started[0]

    def bad():
        raise ValueError("no such source")
    with pytest.raises(ValueError, match="no such source"):
        V.run_supervised(spark, {"good": good, "bad": bad})
    assert not started[0].isActive


def test_late_rows_and_observed_metrics_by_micro_batch(spark):
    rows, late = ticks(spark, 300), ticks(spark, 7, shift=-86_400_000)
    stream = V.observed(time_ordered(rows, "event_time", "test-late", files=3, flush=late), "seen", rows=F.count(F.lit(1)), last=F.max("event_time"))
    out = fresh_dir(spark, "test-late")
    log = V.run_supervised(spark, {"q": lambda: sinks.append_stream(Q.dedup_ticker_stream(stream), out, fresh_dir(spark, "test-late-state"), once=True)})
    table = log.table(spark).collect()
    assert sum(r["rows_in"] for r in table) == 307 and sum(r["rows_late"] for r in table) == 7
    assert max(r["watermark"] for r in table if r["watermark"]).startswith("2023-11-15T00:0")
    seen = log.observations(spark).collect()
    assert sum(r["value"] for r in seen if r["metric"] == "seen.rows") == 307
    assert max(r["value"] for r in seen if r["metric"] == "seen.last") == T0 + 299_000
    assert spark.read.parquet(out).count() == 300
    assert later_rows(rows, "event_time", 1000).first()["event_time"] == T0 + 300_000
