"""Streaming queries: dedup, windowed roll-ups and keyed stateful operators.

Declarative windows and watermarked dedup are used wherever they express the semantics. The stateful
operators keep a fixed-size state per symbol and work on the rows of one micro-batch, whose size
the source bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import ms_to_timestamp
from ..operators.candles import ohlc
from ..operators.normalize import closed_minutes
from ..schemas import HEARTBEAT_MS, MINUTE_MS

IDLE_FLUSH_MS = 65_000
MAX_HISTORY = 60


def dedup_ticker_stream(tickers: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """One ticker per (symbol, event time); rows later than the watermark are dropped."""
    return (tickers.filter(F.col("event_time").isNotNull())
            .withColumn("event_timestamp", ms_to_timestamp("event_time"))
            .withWatermark("event_timestamp", watermark)
            .dropDuplicates(["symbol", "event_timestamp"]))


def dedup_kline_stream(klines: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Closed minutes, one per (symbol, start); the watermark also evicts the dedup state."""
    return (closed_minutes(klines.filter(F.col("kline_start").isNotNull()))
            .withColumn("kline_timestamp", ms_to_timestamp("kline_start"))
            .withWatermark("kline_timestamp", watermark)
            .dropDuplicatesWithinWatermark(["symbol", "kline_start"]))


def trade_stream(trades: DataFrame) -> DataFrame:
    return (trades.filter(F.col("event_time").isNotNull())
            .withColumn("event_timestamp", ms_to_timestamp("event_time"))
            .withColumn("trade_timestamp", ms_to_timestamp("trade_time")))


def window_candles(ticks: DataFrame, window: str, watermark: str = "2 minutes", order: str = "seq") -> DataFrame:
    """Tumbling-window candles per symbol, emitted once the watermark passes the window."""
    return (ticks.withColumn("ts", ms_to_timestamp("event_time")).withWatermark("ts", watermark)
            .groupBy(F.window("ts", window), "symbol")
            .agg(*ohlc("price", "price", "price", "price", order), F.sum("volume").alias("volume"))
            .select("symbol", F.unix_millis("window.start").alias("open_time"), "open", "high", "low",
                    "close", "volume"))


def roll_up_stream(klines: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """One-second klines to closed one-minute klines, repeats within the watermark removed."""
    seconds = (klines.filter(F.col("interval") == "1s")
               .withColumn("ts", ms_to_timestamp("kline_start")).withWatermark("ts", watermark)
               .dropDuplicatesWithinWatermark(["symbol", "kline_start"]))
    start = F.unix_millis("window.start")
    return (seconds.groupBy(F.window("ts", "1 minute"), "symbol")
            .agg(*ohlc("open", "high", "low", "close", "kline_start"), F.sum("volume").alias("volume"),
                 F.sum("quote_volume").alias("quote_volume"), F.sum("trade_count").alias("trade_count"))
            .select(start.alias("event_time"), "symbol", start.alias("kline_start"),
                    (start + MINUTE_MS - 1).alias("kline_close"), F.lit("1m").alias("interval"), "open",
                    "high", "low", "close", "volume", "quote_volume", "trade_count",
                    F.lit(True).alias("is_closed")))


def latest_state(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Latest row per symbol as a running aggregate; write it in update mode."""
    values = [c for c in rows.columns if c not in ("symbol", order)]
    return rows.groupBy("symbol").agg(*[F.max_by(c, F.col(order)).alias(c) for c in values],
                                      F.max(order).alias(order))


# ------------------------------------------------------------------ keyed stateful operators

def _sorted_batch(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")


def throttle_stream(ticks: DataFrame, heartbeat_ms: int = HEARTBEAT_MS) -> DataFrame:
    """Ticks whose price changed, or that come a heartbeat after the last one sent."""
    def step(key, batches, state: GroupState):
        rows = _sorted_batch(batches, "seq")
        price, sent_at = state.get if state.exists else (None, None)
        keep = []
        for p, t in zip(rows["price"], rows["event_time"]):
            changed = price is None or p != price
            due = sent_at is None or t - sent_at >= heartbeat_ms
            if changed or due:
                price, sent_at = float(p), int(t)
            keep.append("change" if changed else "heartbeat" if due else "skipped")
        state.update((price, sent_at))
        rows["reason"] = keep
        yield rows.loc[rows["reason"] != "skipped", ["symbol", "seq", "event_time", "price", "reason"]]

    return (ticks.select("symbol", "seq", "event_time", "price").groupBy("symbol")
            .applyInPandasWithState(
                step, "symbol string, seq bigint, event_time bigint, price double, reason string",
                "price double, sent_at bigint", "append", GroupStateTimeout.NoTimeout))


def change_only_stream(rows: DataFrame, order: str = "open_time") -> DataFrame:
    """Candles that differ from the one pushed before them."""
    values = [f for f in rows.schema.fields if f.name not in ("symbol", order)]
    names = [f.name for f in values]
    state_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values)
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def step(key, batches, state: GroupState):
        batch = _sorted_batch(batches, order)
        last, keep = (state.get if state.exists else None), []
        for values_now in batch[names].itertuples(index=False, name=None):
            keep.append(last is None or tuple(last) != values_now)
            last = values_now
        state.update(tuple(x.item() if hasattr(x, "item") else x for x in last))
        yield batch.loc[keep, list(batch.columns)]

    return rows.groupBy("symbol").applyInPandasWithState(
        step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def indicator_stream(klines: DataFrame) -> DataFrame:
    """SMA and EMA per closed candle from the last closes and the two running averages."""
    def step(key, batches, state: GroupState):
        batch = _sorted_batch(batches, "kline_start")
        closes, ema12, ema26 = state.get if state.exists else ([], None, None)
        closes, out = list(closes), []
        for symbol, start, close in zip(batch["symbol"], batch["kline_start"], batch["close"]):
            closes = (closes + [float(close)])[-MAX_HISTORY:]
            ema12 = close if ema12 is None else close * (2 / 13) + ema12 * (1 - 2 / 13)
            ema26 = close if ema26 is None else close * (2 / 27) + ema26 * (1 - 2 / 27)
            mean = {n: sum(closes[-n:]) / n if len(closes) >= n else None for n in (20, 50)}
            out.append((symbol, start, mean[20], mean[50], ema12, ema26, close))
        state.update((closes, float(ema12), float(ema26)))
        yield pd.DataFrame(out, columns=["symbol", "timestamp", "sma20", "sma50", "ema12", "ema26", "close"])

    return (closed_minutes(klines).select("symbol", "kline_start", "close").groupBy("symbol")
            .applyInPandasWithState(
                step, "symbol string, timestamp bigint, sma20 double, sma50 double, ema12 double, "
                      "ema26 double, close double",
                "closes array<double>, ema12 double, ema26 double", "append", GroupStateTimeout.NoTimeout))


def filled_roll_up_stream(klines: DataFrame, idle_ms: int | None = IDLE_FLUSH_MS) -> DataFrame:
    """One-second klines to gap-filled one-minute klines, also emitted when a symbol falls silent.

    State per symbol: the open minute's seconds (at most 60) and the last close before it. A newer
    minute closes the open one; so does a processing-time timeout of ``idle_ms``. Seconds of closed
    minutes are late and dropped. Without ``idle_ms`` the last minute stays open, which suits runs
    that drain their input and end (a timeout keeps asking for further batches).
    """
    cols = ["kline_start", "open", "high", "low", "close", "volume", "quote_volume", "trade_count"]

    def close_minute(symbol, minute, seconds, carry):
        rows = sorted(seconds)
        fill = carry if carry is not None else rows[0][4]
        first = rows[0][1] if rows[0][0] == minute else fill
        highs, lows = [r[2] for r in rows], [r[3] for r in rows]
        if rows[0][0] > minute:
            highs.append(fill)
            lows.append(fill)
        return (symbol, minute, minute + MINUTE_MS - 1, "1m", first, max(highs), min(lows), rows[-1][4],
                sum(r[5] for r in rows), sum(r[6] for r in rows), int(sum(r[7] for r in rows)), True,
                sum(1 for r in rows if r[5] > 0))

    def step(key, batches, state: GroupState):
        symbol, out = key[0], []
        minute, carry, done, flat = state.get if state.exists else (None, None, -1, [])
        seconds = {int(r[0]): r for r in zip(*[iter(flat)] * len(cols))}
        if state.hasTimedOut:
            if seconds:
                out.append(close_minute(symbol, minute, seconds.values(), carry))
                carry, done, seconds = sorted(seconds.values())[-1][4], minute, {}
        else:
            for r in _sorted_batch(batches, ["kline_start", "event_time"])[cols].itertuples(index=False, name=None):
                r = tuple(float(x) for x in r)
                at = int(r[0]) // MINUTE_MS * MINUTE_MS
                if at <= done or (minute is not None and seconds and at < minute):
                    continue
                if seconds and at > minute:
                    out.append(close_minute(symbol, minute, seconds.values(), carry))
                    carry, done, seconds = sorted(seconds.values())[-1][4], minute, {}
                minute = at
                seconds[int(r[0])] = r
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        state.update((minute, carry, done, [x for r in seconds.values() for x in r]))
        names = ["symbol", "kline_start", "kline_close", "interval", "open", "high", "low", "close",
                 "volume", "quote_volume", "trade_count", "is_closed", "real_count"]
        yield pd.DataFrame(out, columns=names)

    schema = ("symbol string, kline_start bigint, kline_close bigint, interval string, open double, "
              "high double, low double, close double, volume double, quote_volume double, "
              "trade_count bigint, is_closed boolean, real_count bigint")
    return (klines.filter(F.col("interval") == "1s").select("symbol", "event_time", *cols)
            .groupBy("symbol").applyInPandasWithState(
                step, schema, "minute bigint, carry double, done bigint, seconds array<double>",
                "append", GroupStateTimeout.NoTimeout if idle_ms is None
                else GroupStateTimeout.ProcessingTimeTimeout))


def project_stream(rows: DataFrame, fn, schema: str) -> DataFrame:
    """User code over pandas batches of a stream or table, for projections columns cannot express."""
    return rows.mapInPandas(fn, schema)


def run_all(spark: SparkSession) -> None:
    """Wait until any query of a multi-query application ends; pass its error on."""
    spark.streams.awaitAnyTermination()
