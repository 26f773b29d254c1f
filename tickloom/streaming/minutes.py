"""One-second klines to gap-filled minutes with keyed map state, timers and expiry.

Per symbol the seconds of the open minute are a map (a second that comes again replaces itself), beside the open minute with its timer and
the last closed minute with its close. A newer minute closes the open one; so does the timer when the symbol falls silent.
Only seconds of the minute that stays open touch the store, so a micro-batch of many minutes costs a few calls a symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import ms_to_timestamp
from ..schemas import DAY_MS, MINUTE_MS
from .queries import IDLE_FLUSH_MS

_VALUES = ["event_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count"]
_STATE = ", ".join(f"{c} {'bigint' if c in ('event_time', 'trade_count') else 'double'}" for c in _VALUES)
MINUTES = ("symbol string, kline_start bigint, kline_close bigint, interval string, open double, high double, low double, close double, "
           "volume double, quote_volume double, trade_count bigint, is_closed boolean, real_count bigint")


def filled_minutes(symbol: str, rows: pd.DataFrame, carry: float | None) -> pd.DataFrame:
    """Closed minutes of one symbol from its seconds in ascending order; silent seconds take the last close at or before them."""
    start = rows["kline_start"].to_numpy()
    minute = start - start % MINUTE_MS
    first = np.flatnonzero(np.concatenate(([True], minute[1:] != minute[:-1])))
    last = np.append(first[1:], len(rows)) - 1
    value = {c: rows[c].to_numpy() for c in _VALUES}
    before = np.concatenate(([value["close"][0] if carry is None else carry], value["close"][last[:-1]]))
    silent = start[first] > minute[first]
    high, low = np.maximum.reduceat(value["high"], first), np.minimum.reduceat(value["low"], first)
    return pd.DataFrame({
        "symbol": symbol, "kline_start": minute[first], "kline_close": minute[first] + MINUTE_MS - 1, "interval": "1m",
        "open": np.where(silent, before, value["open"][first]), "high": np.where(silent, np.maximum(high, before), high),
        "low": np.where(silent, np.minimum(low, before), low), "close": value["close"][last],
        "volume": np.add.reduceat(value["volume"], first), "quote_volume": np.add.reduceat(value["quote_volume"], first),
        "trade_count": np.add.reduceat(value["trade_count"], first), "is_closed": True,
        "real_count": np.add.reduceat((value["volume"] > 0).astype(np.int64), first)})


class MinuteAggregator(StatefulProcessor):
    """Closes a minute at the first newer second, or ``idle_ms`` after it opened.

    On the event clock timers follow the watermark, and what is left of a symbol goes ``keep_ms`` after its flush. On the processing
    clock timers follow the wall clock and every state lives ``keep_ms`` after its last write. Seconds of closed minutes and of
    minutes before the open one are late and dropped; rows without a symbol only move the watermark.
    """

    def __init__(self, idle_ms: int, keep_ms: int, event_clock: bool):
        self.idle_ms, self.keep_ms, self.event_clock = idle_ms, keep_ms, event_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.event_clock else self.keep_ms
        self.handle = handle
        self.seconds = handle.getMapState("seconds", "kline_start bigint", _STATE, ttl)
        self.opened = handle.getValueState("opened", "minute bigint, timer bigint", ttl)
        self.closed = handle.getValueState("closed", "minute bigint, close double", ttl)

    def _stored(self) -> pd.DataFrame:
        rows = [(k[0], *v) for k, v in self.seconds.iterator()]
        return pd.DataFrame(sorted(rows), columns=["kline_start", *_VALUES])

    def _close(self, symbol: str, rows: pd.DataFrame, carry: float | None) -> pd.DataFrame:
        out = filled_minutes(symbol, rows, carry)
        self.closed.update((int(out["kline_start"].iloc[-1]), float(out["close"].iloc[-1])))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        if key[0] is None:
            return
        done, carry = self.closed.get() or (None, None)
        minute, timer = self.opened.get() or (None, None)
        at = new["kline_start"] - new["kline_start"] % MINUTE_MS
        new = new[(at >= (minute if minute is not None else at.min())) & (at > (done if done is not None else at.min() - 1))]
        if not len(new):
            return
        own = new[["kline_start", *_VALUES]].sort_values(["kline_start", "event_time"], kind="stable")
        both = own if minute is None else pd.concat([self._stored(), own]).sort_values("kline_start", kind="stable")
        both = both.drop_duplicates("kline_start", keep="last")
        newest = int(both["kline_start"].iloc[-1]) // MINUTE_MS * MINUTE_MS
        ended = both["kline_start"] < newest
        if ended.any():
            yield self._close(key[0], both[ended], carry)
        if newest != minute:
            self.seconds.clear()
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (newest if self.event_clock else timerValues.getCurrentProcessingTimeInMs()) + self.idle_ms
            self.handle.registerTimer(timer)
            self.opened.update((newest, timer))
        for second in own[own["kline_start"] >= newest].drop_duplicates("kline_start", keep="last").itertuples(index=False):
            self.seconds.updateValue((int(second[0]),), (int(second[1]), *map(float, second[2:-1]), int(second[-1])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        minute, timer = self.opened.get() or (None, None)
        done, carry = self.closed.get() or (None, None)
        if timer == now:
            yield self._close(key[0], self._stored(), carry)
            self.seconds.clear()
            self.opened.clear()
            expiry = minute + self.idle_ms + self.keep_ms
            if self.event_clock and expiry <= timerValues.getCurrentWatermarkInMs():
                self.closed.clear()
            elif self.event_clock:
                self.handle.registerTimer(expiry)
        elif minute is None and done is not None and done + self.idle_ms + self.keep_ms <= now:
            self.closed.clear()


def use_column_families(spark: SparkSession) -> None:
    """Stateful processors keep several states a key, which the RocksDB store has room for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def idle_roll_up_stream(klines: DataFrame, idle_ms: int = IDLE_FLUSH_MS, keep_ms: int = DAY_MS, clock: str = "event",
                        watermark: str = "10 seconds") -> DataFrame:
    """Gap-filled minutes; a silent symbol's open minute is flushed by a timer of the ``clock``: ``event`` or ``processing``."""
    if clock not in ("event", "processing"):
        raise ValueError("clock is event or processing")
    use_column_families(klines.sparkSession)
    seconds = klines.filter(F.col("interval") == "1s").select("symbol", "kline_start", *_VALUES)
    if clock == "event":
        seconds = seconds.withColumn("ts", ms_to_timestamp("kline_start")).withWatermark("ts", watermark)
    return seconds.groupBy("symbol").transformWithStateInPandas(
        MinuteAggregator(idle_ms, keep_ms, clock == "event"), MINUTES, "append", "EventTime" if clock == "event" else "ProcessingTime")
