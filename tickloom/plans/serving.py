"""The served queries: last-N, ranges, recent and historical candles, tickers and pages.

Each is one lazy plan over all requested symbols. Time filters are plain comparisons on the stored
column (plus the partition date where the table has one), so they reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import ms_to_timestamp, symbol_is_valid
from ..operators.candles import interval_ms, resample
from ..operators.lookup import enrich_with_live
from ..operators.merge import best_by_volume, newest_n, prepend_older, priority_merge
from ..operators.sizing import small_side
from ..schemas import (HOUR_MS, MAX_HISTORICAL, MAX_KLINES, MAX_RANGE_MS, MINUTE_MS,
                       STORE_RETENTION_MS, SYMBOL_PATTERN)

HOURLY_FALLBACK = ("1h", "4h", "1d", "1w")


def checked_symbol(symbol: str) -> str:
    name = symbol.strip().upper()
    if not re.fullmatch(SYMBOL_PATTERN, name):
        raise ValueError("Invalid symbol")
    return name


def checked_limit(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def checked_range(start_ms: int, end_ms: int) -> None:
    if end_ms <= start_ms:
        raise ValueError("end must be greater than start")
    if end_ms - start_ms > MAX_RANGE_MS:
        raise ValueError("range cannot exceed 1 year")


def request_problem(most: int) -> Column:
    """What is wrong with a row (symbol, start_ms, end_ms, limit) of a table of requests; null for a good one."""
    span = F.col("end_ms") - F.col("start_ms")
    return (F.when(~symbol_is_valid("symbol"), "Invalid symbol")
            .when(~F.coalesce(F.col("limit").between(1, most), F.lit(False)), f"limit must be between 1 and {most}")
            .when(~F.coalesce(span > 0, F.lit(False)), "end must be greater than start")
            .when(span > MAX_RANGE_MS, "range cannot exceed 1 year"))


def for_symbols(df: DataFrame, symbols: Sequence[str] | None) -> DataFrame:
    """All symbols, or the given ones (validated); a pushed ``IN`` filter, not a join."""
    return df if symbols is None else df.filter(F.col("symbol").isin([checked_symbol(s) for s in symbols]))


def in_range(df: DataFrame, start_ms: int | None = None, end_ms: int | None = None,
             time: str = "open_time") -> DataFrame:
    """``start <= time < end``, with the implied partition filter when the table has ``dt``."""
    has_dt = "dt" in df.columns
    if start_ms is not None:
        df = df.filter(F.col(time) >= start_ms)
        if has_dt:
            df = df.filter(F.col("dt") >= F.to_date(ms_to_timestamp(F.lit(start_ms))))
    if end_ms is not None:
        df = df.filter(F.col(time) < end_ms)
        if has_dt:
            df = df.filter(F.col("dt") <= F.to_date(ms_to_timestamp(F.lit(end_ms - 1))))
    return df


def look_back(df: DataFrame, hours: int, now_ms: int, time: str = "open_time",
              retention_ms: int = STORE_RETENTION_MS["1m"]) -> DataFrame:
    """Rows of the last ``hours``, never further back than the retention."""
    return in_range(df, now_ms - min(hours * HOUR_MS, retention_ms), None, time)


def last_before(candles: DataFrame, n: int, end_ms: int | None = None,
                start_ms: int | None = None) -> DataFrame:
    """The newest ``n`` rows per symbol within the range."""
    return newest_n(in_range(candles, start_ms, end_ms), n)


def stored_minutes(klines: DataFrame) -> DataFrame:
    """Closed one-minute klines as candles."""
    keep = klines.filter((F.col("interval") == "1m") & F.col("is_closed"))
    extra = ["dt"] if "dt" in klines.columns else []
    return keep.select("symbol", F.col("kline_start").alias("open_time"), "open", "high", "low",
                       "close", "volume", *extra)


def recent_seconds(payloads: DataFrame, limit: int, now_ms: int, end_ms: int | None = None) -> DataFrame:
    """One-second candles: the look-back window, else (per symbol) its newest seconds.

    A repeated second keeps the row with the highest volume.
    """
    need = limit + 2
    if end_ms is not None:
        return newest_n(best_by_volume(in_range(payloads, end_ms - need * 1000, end_ms)), limit)
    since = now_ms - max(need * 1000, 120_000)
    recent = in_range(payloads, since)
    stale = payloads.join(recent.select("symbol").distinct(), "symbol", "left_anti")
    return newest_n(best_by_volume(recent.unionByName(stale)), limit)


def base_minutes(hot: DataFrame, cold: DataFrame | None, step_ms: int, limit: int, end_ms: int,
                 cutoff_ms: int, look_back_ms: int | None = None) -> DataFrame:
    """One-minute rows that can build the ``limit`` newest bars before ``end_ms``.

    The hot tier serves times from the cutoff on; the cold tier serves older times, and all times
    of a symbol the hot tier does not know. ``look_back_ms`` bounds the scan for dense series;
    without it the answer is exact however sparse a series is. Backward paging is not needed: the
    bars are aggregated in one scan.
    """
    start = None if look_back_ms is None else end_ms - look_back_ms
    if cold is None:
        return in_range(hot, start, end_ms)
    recent = in_range(hot, start if start is None else max(start, cutoff_ms), end_ms)
    recent = recent if start is not None else recent.filter(F.col("open_time") >= cutoff_ms)
    older = in_range(cold, start, min(end_ms, cutoff_ms))
    unknown = in_range(cold, max(cutoff_ms, start or 0), end_ms).join(
        recent.select("symbol").distinct(), "symbol", "left_anti")
    return priority_merge(older.unionByName(unknown), recent)


def fill_hours(minutes: DataFrame, hourly: DataFrame) -> DataFrame:
    """The minutes, and the hourly rows of those hours of a symbol that have no minute."""
    known = minutes.select("symbol", (F.col("open_time") - F.col("open_time") % HOUR_MS).alias("open_time")).distinct()
    return minutes.unionByName(hourly.join(known, ["symbol", "open_time"], "left_anti"))


def recent_klines(interval: str, limit: int, now_ms: int, hot: DataFrame, cold: DataFrame | None = None,
                  tickers: DataFrame | None = None, hourly: DataFrame | None = None,
                  end_ms: int | None = None,
                  retention_ms: int = STORE_RETENTION_MS["1m"]) -> DataFrame:
    """Newest ``limit`` bars per symbol; with ``end_ms`` the ones before it (scroll-back).

    Live bars (no ``end_ms``) come from the hot tier alone and, above one minute, follow the latest
    ticker. Scroll-back reads both tiers and, for an hourly or longer interval, the hourly table in
    those hours of a symbol that have no minutes: every hour comes from one tier.
    """
    checked_limit(limit, MAX_KLINES)
    step = interval_ms(interval)
    label = interval.strip().lower()
    if end_ms is None:
        rows = in_range(hot, now_ms - retention_ms)
    else:
        cutoff = now_ms - retention_ms
        rows = base_minutes(hot, cold, step, limit, end_ms, cutoff)
        if hourly is not None and label in HOURLY_FALLBACK:
            rows = fill_hours(rows, in_range(hourly, None, end_ms))
    bars = rows if step <= MINUTE_MS else resample(rows, step)
    if end_ms is not None:
        bars = in_range(bars, None, end_ms)
    elif tickers is not None and step > MINUTE_MS:
        bars = enrich_with_live(bars, tickers, step, now_ms)
    return newest_n(bars, limit)


def historical_klines(interval: str, start_ms: int, end_ms: int, limit: int, now_ms: int,
                      hot: DataFrame, cold: DataFrame, hourly: DataFrame | None = None,
                      retention_ms: int = STORE_RETENTION_MS["1m"]) -> DataFrame:
    """Bars of ``[start, end)``, the newest ``limit`` per symbol.

    The hot tier serves times from the retention cutoff on, the cold tier older ones. A symbol
    without one-minute rows falls back to the hourly table for an hourly or longer interval.
    Only bars whose start lies in the range are returned.
    """
    checked_range(start_ms, end_ms)
    checked_limit(limit, MAX_HISTORICAL)
    step, label = interval_ms(interval), interval.strip().lower()
    cutoff = now_ms - retention_ms
    tiers = []
    if end_ms > max(start_ms, cutoff):
        tiers.append(in_range(hot, max(start_ms, cutoff), end_ms))
    if min(end_ms, cutoff) > start_ms:
        tiers.append(in_range(cold, start_ms, min(end_ms, cutoff)))
    rows = priority_merge(*tiers)
    if hourly is not None and label in HOURLY_FALLBACK:
        known = rows.select("symbol").distinct()
        rows = rows.unionByName(in_range(hourly, start_ms, end_ms).join(known, "symbol", "left_anti"))
    bars = rows if step <= MINUTE_MS else resample(rows, step)
    return newest_n(in_range(bars, start_ms, end_ms), limit)


def tiered_lookup(hot: DataFrame, cold: DataFrame, hourly: DataFrame) -> DataFrame:
    """Hot rows first, else cold ones, else hourly ones, per symbol and time."""
    return priority_merge(hourly, cold, hot)


def extend_to(current: DataFrame, history: DataFrame, required: int) -> DataFrame:
    """Extend series shorter than ``required`` bars backwards from their first bar."""
    series = current.groupBy("symbol").agg(F.count(F.lit(1)).alias("_have"), F.min("open_time").alias("_first"))
    short = series.filter(F.col("_have") < required).withColumn(
        "_fetch", F.greatest(F.lit(required) - F.col("_have") + 20, F.lit(required)))
    older = history.join(small_side(short), "symbol").filter(F.col("open_time") < F.col("_first"))
    # The fetch size differs per symbol but never exceeds this, which bounds the shuffle.
    w = W.partitionBy("symbol").orderBy(F.col("open_time").desc())
    picked = newest_n(older, required + 20).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.col("_fetch"))
    return prepend_older(current, picked.select(*current.columns))


def all_tickers(latest: DataFrame) -> DataFrame:
    return latest.orderBy("symbol")

