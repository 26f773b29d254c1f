"""Hand-computed values for the operators and validations."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import book as B, candles as C, lookup as L, merge as M, normalize as N
from tickloom.plans import paging, serving as P
from tickloom.sources import topics

from .conftest import as_dicts, candle_frame

FIVE_MIN = 300_000


def one(spark, text):
    return spark.createDataFrame([(text if isinstance(text, str) else json.dumps(text),)], "value string")


def test_resample_golden(spark):
    rows = [(0, 10.0, 20.0, 9.0, 15.0, 100.0), (60_000, 15.0, 22.0, 14.0, 18.0, 150.0), (120_000, 18.0, 21.0, 8.0, 19.0, 200.0)]
    (bar,) = as_dicts(C.resample(candle_frame(spark, rows), FIVE_MIN))
    assert bar == {"symbol": "AUSDT", "open_time": 0, "open": 10.0, "high": 22.0, "low": 8.0, "close": 19.0, "volume": 450.0}


def test_resample_buckets_are_epoch_aligned(spark):
    start = 1_700_000_000_000
    rows = [(start + i * 60_000, 100.0 + i, 105.0 + i, 98.0 + i, 103.0 + i, 10.0 + i) for i in range(10)]
    bars = as_dicts(C.resample(candle_frame(spark, rows), FIVE_MIN))
    assert len(bars) == 3 and all(b["open_time"] % FIVE_MIN == 0 for b in bars)
    assert sum(b["volume"] for b in bars) == sum(10.0 + i for i in range(10))


def test_weeks_start_on_thursday(spark):
    # 2024-01-08 is a Monday; its bucket starts on Thursday 2024-01-04.
    row = spark.range(1).select(S.bucket(F.lit(1_704_672_000_000), C.interval_ms("1w")).alias("t")).first()
    assert row["t"] == 1_704_326_400_000


def test_resample_steps_compose(spark):
    rows = [(i * 60_000, 1.0 + i % 7, 9.0 + i % 5, 0.5 + i % 3, 2.0 + i % 11, 1.0) for i in range(3000)]
    minutes = candle_frame(spark, rows)
    twice = C.resample(C.resample(minutes, 3_600_000), 86_400_000)
    key = lambda r: r["open_time"]
    assert sorted(as_dicts(twice), key=key) == sorted(as_dicts(C.resample(minutes, 86_400_000)), key=key)


def test_priority_merge_prefers_incoming(spark):
    old = candle_frame(spark, [(1000, 1.0, 2.0, 0.5, 1.5, 10.0), (2000, 1.5, 2.5, 1.0, 2.0, 20.0)])
    new = candle_frame(spark, [(1000, 1.0, 2.0, 0.5, 1.6, 11.0)])
    merged = {r["open_time"]: r["close"] for r in as_dicts(M.priority_merge(old, new))}
    assert merged == {1000: 1.6, 2000: 2.0}
    assert sorted(map(str, as_dicts(M.priority_merge(old, new.limit(0))))) == sorted(map(str, as_dicts(old)))
    once = M.priority_merge(old, new)
    assert sorted(map(str, as_dicts(M.priority_merge(once, new)))) == sorted(map(str, as_dicts(once)))


def test_best_by_volume_keeps_the_earliest_of_equals(spark):
    rows = candle_frame(spark, [(1000, 1.0, 1.0, 1.0, 1.0, 5.0, 2), (1000, 2.0, 2.0, 2.0, 2.0, 5.0, 1), (1000, 3.0, 3.0, 3.0, 3.0, 4.0, 0)], ", seq long")
    (best,) = as_dicts(M.best_by_volume(rows))
    assert best["close"] == 2.0


@pytest.mark.parametrize("interval,expected", [("1h", {1: 1.0, 2: 9.0, 3: 3.0, 4: 9.0}), ("1s", {1: 1.0, 2: 9.0, 3: 9.0, 4: 9.0})])
def test_poll_merge_rules(spark, interval, expected):
    current = candle_frame(spark, [(t, 1.0, 1.0, 1.0, float(t), 1.0) for t in (1, 2, 3)])
    polled = candle_frame(spark, [(t, 1.0, 1.0, 1.0, 9.0, 1.0) for t in (0, 2, 3, 4)])
    out = {r["open_time"]: r["close"] for r in as_dicts(M.poll_merge(current, polled, interval))}
    assert out == expected
    assert len(as_dicts(M.poll_merge(current, polled, interval, max_bars=2))) == 2


def test_ticker_defaults_and_case_distinct_keys(spark):
    full = {"E": 5, "s": "BTCUSDT", "c": "1.5", "b": "1.4", "p": "0.25", "P": "2.5", "n": 7}
    (row,) = as_dicts(N.normalize_tickers(one(spark, full)))
    assert (row["close"], row["h24_price_change"], row["h24_price_change_pct"], row["h24_trade_count"]) == (1.5, 0.25, 2.5, 7)
    assert row["ask"] == 0.0 and row["h24_volume"] == 0.0
    assert as_dicts(N.normalize_tickers(one(spark, "not json"))) == []


def test_values_of_a_wrong_type_reject_a_message(spark):
    good = {"E": 1, "s": "A", "c": "1.5"}
    for bad in ({**good, "c": "abc"}, {**good, "n": "many"}, {**good, "v": {"x": 1}}, {**good, "E": "soon"}):
        assert as_dicts(N.normalize_tickers(one(spark, bad))) == []
        assert N.split_malformed(one(spark, bad))[1].count() == 1
    assert N.split_malformed(one(spark, good))[0].count() == 1
    assert as_dicts(N.normalize_tickers(one(spark, [good]))) == []
    body = {"t": 0, "T": 59_999, "i": "1m", "o": "1", "h": "1", "l": "1", "c": "x", "v": "1", "q": "1", "n": 1, "x": True}
    assert as_dicts(N.normalize_klines(one(spark, {"E": 1, "s": "A", "k": body}))) == []


def test_kline_and_trade_messages(spark):
    kline = {"E": 1, "s": "ETHUSDT", "k": {"t": 60_000, "T": 119_999, "i": "1m", "o": "1", "h": "3", "l": "0.5", "c": "2", "v": "4", "q": "8", "n": 9, "x": True}}
    (row,) = as_dicts(N.normalize_klines(one(spark, kline)))
    assert (row["kline_start"], row["kline_close"], row["high"], row["is_closed"]) == (60_000, 119_999, 3.0, True)
    trade = {"E": 1, "s": "X", "a": 3, "p": "1.25", "q": "2", "T": 4, "m": False}
    assert as_dicts(N.normalize_trades(one(spark, trade)))[0]["price"] == 1.25
    assert as_dicts(N.normalize_trades(one(spark, {k: v for k, v in trade.items() if k != "p"}))) == []


def test_depth_alternate_keys_and_empty_book(spark):
    now = F.lit(77).cast("bigint")
    snapshot = {"lastUpdateId": 5, "bids": [["1.0", "2.0"]], "asks": [["1.5", "1"]], "s": "btcusdt"}
    (row,) = as_dicts(N.normalize_depth(one(spark, snapshot), received_ms=now))
    assert row["symbol"] == "BTCUSDT" and row["event_time"] == 77 and row["bids"] == [{"price": 1.0, "qty": 2.0}]
    (row,) = as_dicts(N.normalize_depth(one(spark, {"E": 1, "u": 6, "b": [["3", "4"]], "s": "x"})))
    assert row["last_update_id"] == 6 and row["bids"] == [{"price": 3.0, "qty": 4.0}] and row["asks"] == []


def test_envelope_symbol_from_stream(spark):
    message = {"stream": "ethusdt@depth20@100ms", "data": {"lastUpdateId": 1, "bids": [["1", "2"]], "asks": []}}
    unwrapped = N.unwrap_envelopes(one(spark, message))
    (row,) = as_dicts(unwrapped)
    assert (row["event_type"], row["symbol"]) == ("depth", "ETHUSDT")
    (depth,) = as_dicts(N.route_events(unwrapped)["depth"])
    assert depth["symbol"] == "ETHUSDT" and depth["last_update_id"] == 1
    other = {"e": "aggTrade", "s": "BTCEUR"}
    assert as_dicts(N.route_events(N.unwrap_envelopes(one(spark, other)))["trade"]) == []


def test_positional_kline_skips_bad_rows(spark):
    rows = spark.createDataFrame([("A", '[60000,"1","2","0.5","1.5","10",119999,"15",3,"0","0","0"]'), ("A", '[1,"x"]')], "symbol string, value string")
    (row,) = as_dicts(N.positional_klines(rows))
    assert (row["kline_close"], row["quote_volume"], row["trade_count"], row["interval"]) == (119_999, 15.0, 3, "1m")


@pytest.mark.parametrize("text,ok", [("BTCUSDT", True), ("  ethusdt  ", True), ("1INCHUSDT", True), ("BTC/USDT", False), ("", False),
                                     ("A" * 21, False), ("'; DROP TABLE", False), ("<script>", False), ("../etc", False), ("A\x00B", False), ("BTC🚀", False)])
def test_symbol_validation(spark, text, ok):
    row = spark.createDataFrame([(text,)], "symbol string").select(S.symbol_is_valid("symbol").alias("ok")).first()
    assert row["ok"] is ok
    if ok:
        assert P.checked_symbol(text) == text.strip().upper()
    else:
        with pytest.raises(ValueError):
            P.checked_symbol(text)


def test_request_bounds():
    assert C.interval_ms("  1H ") == 3_600_000
    for bad in (lambda: C.interval_ms("2m"), lambda: P.checked_range(5, 5), lambda: P.checked_range(0, 366 * 86_400_000),
                lambda: P.checked_limit(0, 10), lambda: P.checked_limit(11, 10), lambda: L.recent_trades(None, 201)):
        with pytest.raises(ValueError):
            bad()


def test_live_enrichment_rules(spark):
    bars = candle_frame(spark, [(0, 1.0, 2.0, 0.5, 1.5, 10.0), (3_600_000, 2.0, 3.0, 1.0, 2.5, 10.0)])
    tick = lambda t, p: spark.createDataFrame([("AUSDT", p, t)], "symbol string, price double, event_time long")
    newest = lambda df: max(as_dicts(df), key=lambda r: r["open_time"])
    same = newest(L.enrich_with_live(bars, tick(3_700_000, 4.0), 3_600_000, now_ms=3_700_000))
    assert (same["open"], same["high"], same["low"], same["close"]) == (2.0, 4.0, 1.0, 4.0)
    closed = newest(L.enrich_with_live(bars, tick(3_700_000, 4.0), 3_600_000, now_ms=7_200_000))
    assert closed["close"] == 2.5
    later = newest(L.enrich_with_live(bars, tick(7_300_000, 4.0), 3_600_000, now_ms=7_300_000))
    assert later["open_time"] == 7_200_000 and later["low"] == later["close"] == 4.0 and later["volume"] == 0.0
    stale = as_dicts(L.enrich_with_live(bars, tick(10, 4.0), 3_600_000, now_ms=10))
    assert len(stale) == 2 and newest(bars)["close"] == 2.5


def test_gap_fill_windows(spark):
    bars = candle_frame(spark, [(61_000, 1.0, 2.0, 0.5, 1.5, 3.0), (63_000, 1.6, 1.7, 1.4, 1.65, 2.0), (302_000, 5.0, 6.0, 4.0, 5.5, 1.0)])
    dense = {r["open_time"]: r for r in as_dicts(C.gap_fill(bars, 1000, 60_000))}
    assert len(dense) == 120 and dense[60_000]["close"] == 1.5 and dense[62_000]["open"] == 1.5
    assert dense[119_000]["close"] == 1.65 and dense[300_000]["close"] == 1.65 and dense[359_000]["close"] == 5.5
    assert dense[300_000]["volume"] == 0.0 and dense[300_000]["is_filled"]
    whole = as_dicts(C.gap_fill(bars, 1000))
    assert len(whole) == 242


def test_gap_fill_across_chunks(spark):
    bars = candle_frame(spark, [(0, 1.0, 1.0, 1.0, 1.0, 1.0), (10_000_000, 2.0, 2.0, 2.0, 2.0, 1.0)])
    dense = C.gap_fill(bars, 1000)
    assert dense.count() == 10_001 and dense.select("open_time").distinct().count() == 10_001


def test_gap_detection_ignores_backfill(spark):
    rows = [("A", 0, 1.0, 0, None), ("A", 200_000, 1.0, 1, "backfill"), ("A", 600_000, 1.0, 2, None)]
    ticks = spark.createDataFrame(rows, "symbol string, event_time long, price double, seq long, source string")
    (gap,) = as_dicts(C.detect_gaps(ticks))
    assert gap == {"symbol": "A", "gap_start": 120_000, "gap_end": 660_000, "elapsed_ms": 600_000}


def test_book_values(spark):
    books = spark.createDataFrame([("A", 1, 1, [(100.0, 1.0), (99.0, 2.0)], [(101.0, 4.0)]), ("B", 1, 1, [], [(5.0, 1.0)])],
                                  "symbol string, event_time long, last_update_id long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    a, b = sorted(as_dicts(B.spread_percent(B.book_features(books))), key=lambda r: r["symbol"])
    assert (a["best_bid"], a["best_ask"], a["spread"], a["spread_pct"]) == (100.0, 101.0, 1.0, 0.99)
    assert (b["best_bid"], b["spread"], b["spread_pct"], b["bid_depth"]) == (0.0, 0.0, 0.0, 0)
    curve = {(r["symbol"], r["side"], r["level"]): (r["total"], r["depth_pct"]) for r in as_dicts(B.depth_curve(B.level_rows(books)))}
    assert curve[("A", "bid", 1)] == (1.0, 1.0 / 3.0 * 100) and curve[("A", "bid", 2)] == (3.0, 100.0)


def test_recent_trades_follow_the_newer_price(spark):
    rows = [("A", 1000, 10.0, 1.0, 1), ("A", 2000, 11.0, 1.0, 2), ("A", 3000, 9.0, 1.0, 3), ("A", 4000, 10.0, 1.0, 4)]
    ticks = spark.createDataFrame(rows, "symbol string, event_time long, price double, volume double, seq long")
    out = sorted(as_dicts(L.recent_trades(ticks, 10)), key=lambda r: r["time"])
    # The repeated (10, 1) pair keeps its last time only.
    assert [(r["time"], r["side"]) for r in out] == [(2000, "buy"), (3000, "sell"), (4000, "buy")]


def test_every_hour_comes_from_one_tier(spark):
    hour = 3_600_000
    minutes = candle_frame(spark, [(i * 60_000, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(60)])
    hourly = candle_frame(spark, [(h * hour, 1.0, 1.0, 1.0, 1.0, 60.0) for h in range(2)])
    out = {r["open_time"]: r["volume"] for r in as_dicts(P.recent_klines("1h", 10, 400 * 86_400_000, minutes, cold=minutes, hourly=hourly, end_ms=2 * hour))}
    assert out == {0: 60.0, hour: 60.0}


def test_long_series_are_not_capped(spark):
    week = 7 * 86_400_000
    hourly = candle_frame(spark, [(h * 3_600_000, 1.0, 1.0, 1.0, 1.0, 1.0) for h in range(17_000)])
    none = hourly.limit(0)
    assert P.recent_klines("1w", 100, 4000 * 86_400_000, none, cold=none, hourly=hourly, end_ms=200 * week).count() == 100
    current = candle_frame(spark, [(20_000 * 3_600_000, 1.0, 1.0, 1.0, 1.0, 1.0)])
    assert P.extend_to(current, hourly, 900).count() == 1 + 919
    assert M.apply_live(hourly, current, "1s").count() == 17_001
    assert M.poll_merge(hourly, current, "1h").count() == 17_001


def test_stale_seconds_count_after_repeats_are_removed(spark):
    rows = candle_frame(spark, [(s * 1000, 1.0, 1.0, 1.0, 1.0, float(r), r) for s in range(100) for r in range(10)], ", seq long")
    assert P.recent_seconds(rows, 50, 10_000_000).count() == 50


def test_deep_books_keep_every_level(spark):
    levels = spark.createDataFrame([("A", 1, "bid" if i % 2 else "ask", i // 2 + 1, 100.0 + i, 1.0, i) for i in range(100)],
                                   "symbol string, event_time long, side string, level long, price double, qty double, update_id long")
    (row,) = as_dicts(B.level_features(levels))
    assert (row["bid_depth"], row["ask_depth"], row["last_update_id"]) == (50, 50, 99)
    assert B.depth_curve(levels).agg(F.max("total")).first()[0] == 50.0


def test_page_is_clamped(spark):
    rows = spark.range(25).select(F.format_string("S%02d", "id").alias("symbol"))
    assert [r["symbol"] for r in paging.page(rows, ["symbol"], 99).collect()] == ["S20", "S21", "S22", "S23", "S24"]
    assert paging.page(rows, ["symbol"], 0).count() == 10


def test_framed_message_bytes(spark):
    rows = spark.createDataFrame([("A", 1)], "symbol string, n long")
    (row,) = topics.encode_framed(rows, 258).collect()
    assert bytes(row["value"])[:5] == b"\x00\x00\x00\x01\x02" and row["key"] == "A"
    bad = spark.createDataFrame([(b"\x01\x00\x00\x00\x01{}",)], "value binary")
    assert topics.decode_framed(bad, rows.schema).count() == 0


def test_historical_range_and_fallback(spark):
    hour = 3_600_000
    minutes = candle_frame(spark, [(i * 60_000, 1.0, 1.0, 1.0, float(i), 1.0) for i in range(180)])
    hourly = candle_frame(spark, [(h * hour, 2.0, 2.0, 2.0, 2.0, 1.0) for h in range(3)], symbol="BUSDT")
    now = 200 * 86_400_000
    out = P.historical_klines("1h", 30 * 60_000, 3 * hour, 500, now, minutes, minutes, hourly)
    found = {(r["symbol"], r["open_time"]): r["volume"] for r in as_dicts(out)}
    # The first bucket starts before the range and is left out.
    assert found == {("AUSDT", hour): 60.0, ("AUSDT", 2 * hour): 60.0, ("BUSDT", hour): 1.0, ("BUSDT", 2 * hour): 1.0}
    assert P.historical_klines("5m", 0, 3 * hour, 500, now, minutes, minutes, hourly).filter("symbol = 'BUSDT'").count() == 0
