"""OHLCV bucketing: resampling, roll-ups, latest bars, range statistics and gap handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import bucket, half_up
from ..schemas import (BACKFILL, BLOCK_STEPS, INTERVAL_MS, LISTING_EPOCH_MS, MIN_GAP_MS, MINUTE_MS)
from .blocks import trailing, with_carry, with_row_index

CANDLE_COLS = ("symbol", "open_time", "open", "high", "low", "close", "volume")


def order_key(order: str | Sequence[str]) -> Column:
    """One sort value for ``min_by``/``max_by``.

    A single numeric column keeps the aggregation buffer fixed-width, so Spark hashes instead of
    sorting; several columns become a struct.
    """
    cols = [order] if isinstance(order, str) else list(order)
    return F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)


def ohlc(open_: str, high: str, low: str, close: str, order: str | Sequence[str]) -> list[Column]:
    at = order_key(order)
    return [F.min_by(open_, at).alias("open"), F.max(high).alias("high"),
            F.min(low).alias("low"), F.max_by(close, at).alias("close")]


def resample(candles: DataFrame, step_ms: int, time: str = "open_time",
             extra: Sequence[str] = ()) -> DataFrame:
    """Candles re-bucketed to a larger step; partial aggregation runs before the shuffle."""
    sums = [F.sum(c).alias(c) for c in extra]
    return (candles.groupBy("symbol", bucket(time, step_ms).alias("open_time"))
            .agg(*ohlc("open", "high", "low", "close", time),
                 F.round(F.sum("volume"), 8).alias("volume"), *sums))


def candles_from_ticks(ticks: DataFrame, step_ms: int, order: str | Sequence[str] = "seq",
                       key: str = "symbol") -> DataFrame:
    """Candles straight from prices; ``order`` must be unique within a symbol."""
    return (ticks.groupBy(key, bucket("event_time", step_ms).alias("open_time"))
            .agg(*ohlc("price", "price", "price", "price", order),
                 F.sum("volume").alias("volume"),
                 F.sum(F.col("price") * F.col("volume")).alias("quote_volume"),
                 F.count(F.lit(1)).alias("trade_count")))


def latest_write(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The newest whole row per key.

    With one ordering column every value is its own ``max_by`` over the same fixed-width key,
    so numeric rows stay in a hash aggregate; all columns pick the same row because ``order``
    is unique within a key.
    """
    values = [c for c in df.columns if c not in keys]
    if not isinstance(order, str) and len(order) > 1:
        picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), order_key(order)).alias("_row"))
        return picked.select(*keys, "_row.*")
    at = order_key(order)
    return df.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in values])


def roll_up_seconds(klines: DataFrame) -> DataFrame:
    """Closed one-minute klines from one-second klines; a repeated second keeps its last write."""
    seconds = klines.filter(F.col("interval") == "1s").select(
        "symbol", "kline_start", "event_time", "open", "high", "low", "close", "volume",
        "quote_volume", "trade_count")
    # Partitioned by minute once, both aggregations run without a further shuffle.
    seconds = seconds.withColumn("_minute", bucket("kline_start", MINUTE_MS)).repartition("symbol", "_minute")
    once = latest_write(seconds, ["symbol", "_minute", "kline_start"], "event_time")
    minutes = once.groupBy("symbol", "_minute").agg(
        *ohlc("open", "high", "low", "close", "kline_start"),
        *[F.sum(c).alias(c) for c in ("volume", "quote_volume", "trade_count")])
    return minutes.select(
        "symbol", F.col("_minute").alias("kline_start"),
        (F.col("_minute") + MINUTE_MS - 1).alias("kline_close"), F.lit("1m").alias("interval"),
        "open", "high", "low", "close", "volume", "quote_volume", "trade_count",
        F.lit(True).alias("is_closed"))


def newest_bar(candles: DataFrame, step_ms: int) -> DataFrame:
    """The still-open bar per symbol: the bucket of its newest source candle, aggregated.

    Aggregating per bucket first keeps both shuffles small and needs no join on the symbol.
    """
    bars = (candles.groupBy("symbol", bucket("open_time", step_ms).alias("open_time"))
            .agg(*ohlc("open", "high", "low", "close", "open_time"),
                 F.round(F.sum("volume"), 8).alias("volume"),
                 F.max("open_time").alias("source_time")))
    return latest_write(bars.withColumn("_at", F.col("open_time")), ["symbol"], "_at").drop("_at")


def last_per_step(ticks: DataFrame, step_ms: int = MINUTE_MS, order: str = "seq") -> DataFrame:
    """Last price per step, stamped with the end of the step; empty steps are absent."""
    return (ticks.groupBy("symbol", (bucket("event_time", step_ms) + step_ms).alias("time"))
            .agg(F.max_by("price", F.col(order)).alias("price")))


def high_watermarks(symbols: DataFrame, klines: DataFrame, unknown_ms: int | None = LISTING_EPOCH_MS) -> DataFrame:
    """Next open time to import per symbol: after its newest minute, ``unknown_ms`` for a symbol without one."""
    newest = (klines.filter(F.col("interval") == "1m").groupBy("symbol")
              .agg((F.max("kline_start") + MINUTE_MS).alias("start_ms")))
    return (symbols.select("symbol").join(newest, "symbol", "left")
            .select("symbol", F.coalesce("start_ms", F.lit(unknown_ms).cast("bigint")).alias("start_ms")))


def first_available(symbols: DataFrame, klines: DataFrame) -> DataFrame:
    oldest = klines.groupBy("symbol").agg(F.min("kline_start").alias("start_ms"))
    return (symbols.select("symbol").join(oldest, "symbol", "left")
            .select("symbol", F.coalesce("start_ms", F.lit(LISTING_EPOCH_MS)).alias("start_ms")))


def range_stats(candles: DataFrame) -> DataFrame:
    """High, low, volume, change and the place of the last close within the range."""
    stats = candles.groupBy("symbol").agg(
        F.min_by("open", "open_time").alias("first_open"),
        F.max_by("close", "open_time").alias("last_close"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").alias("total_volume"))
    change = F.col("last_close") - F.col("first_open")
    span = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(F.col("high") - F.col("low"))
    return stats.select(
        "symbol", "high", "low", "total_volume", "last_close", change.alias("change"),
        half_up(change / F.col("first_open") * 100, 2).alias("change_pct"),
        ((F.col("last_close") - F.col("low")) / span * 100).alias("position_pct"),
        (change >= 0).alias("is_up"))


def sparkline(candles: DataFrame, step_ms: int, width: float = 200.0, height: float = 40.0) -> DataFrame:
    """Closes scaled into a box; x is undefined (null) for a series of one point."""
    rows = with_row_index(
        candles.select("symbol", "open_time", "close"), step_ms * BLOCK_STEPS, ["open_time"],
        stats={"min_close": F.min("close"), "max_close": F.max("close")})
    low, high = F.col("min_close"), F.col("max_close")
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    steps = (F.col("row_count") - 1).cast("double")
    at = (F.col("row_index") - 1).cast("double")
    return rows.select(
        "symbol", "open_time",
        F.when(F.col("row_count") > 1, at / steps * F.lit(width)).alias("x"),
        (F.lit(height) - (F.col("close") - low) / span * F.lit(height)).alias("y"))


def detect_gaps(ticks: DataFrame, min_gap_ms: int = MIN_GAP_MS, since_ms: int | None = None,
                order: str = "seq") -> DataFrame:
    """Silences longer than ``min_gap_ms`` between one-minute points.

    Rows tagged ``source = 'backfill'`` do not count as live data. ``since_ms`` bounds the
    look-back and is applied before the aggregation, so it reaches the scan.
    """
    live = ticks
    if "source" in ticks.columns:
        live = live.filter(F.col("source").isNull() | (F.col("source") != BACKFILL))
    if since_ms is not None:
        live = live.filter(F.col("event_time") >= since_ms)
    points = last_per_step(live.select("symbol", "event_time", "price", order), MINUTE_MS, order)
    steps = trailing(points, 1, MINUTE_MS * BLOCK_STEPS, ["time"],
                     {"elapsed_ms": lambda w: F.col("time") - F.lag("time").over(w)})
    return (steps.filter(F.col("elapsed_ms") > min_gap_ms)
            .select("symbol", (F.col("time") - F.col("elapsed_ms") + MINUTE_MS).alias("gap_start"),
                    F.col("time").alias("gap_end"), "elapsed_ms"))


def gap_totals(gaps: DataFrame) -> DataFrame:
    return (gaps.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gaps"),
                 F.count(F.lit(1)).alias("symbols_with_gaps")))


def _grid(first: Column, last: Column, step_ms: int) -> Column:
    """Times from ``first`` to ``last`` (inclusive); empty when the range is."""
    step = F.lit(step_ms).cast("bigint")
    return F.when(last >= first, F.sequence(first, last, step))


def gap_fill(candles: DataFrame, step_ms: int, window_ms: int | None = None) -> DataFrame:
    """Missing steps become flat candles at the carried close, with volume 0.

    Without ``window_ms`` the grid of a symbol runs from its first to its last candle. With it,
    only windows that hold a candle are filled, each from its first to its last step; seconds
    before the very first candle take that candle's close.

    Each candle emits the steps up to the next candle, so no grid is joined. A long silence is
    first cut into chunks, which bounds the size of any one generated array.
    """
    series = candles.select(*CANDLE_COLS)
    block_ms = step_ms * BLOCK_STEPS
    series = trailing(series, 1, block_ms, ["open_time"],
                      {"next_time": lambda w: F.lag("open_time").over(w)}, reverse=True)
    t, nxt = F.col("open_time"), F.col("next_time")
    own = F.struct(t.alias("lo"), t.alias("hi"))
    if window_ms is None:
        spans = F.array(own, F.struct((t + step_ms).alias("lo"), (nxt - step_ms).alias("hi")))
    else:
        series = trailing(series, 1, block_ms, ["open_time"],
                          {"prev_time": lambda w: F.lag("open_time").over(w)})
        own_end = bucket(t, window_ms) + (window_ms - step_ms)
        spans = F.array(
            own,
            F.struct((t + step_ms).alias("lo"),
                     F.least(own_end, F.coalesce(nxt - step_ms, own_end)).alias("hi")),
            F.struct(F.greatest(bucket(nxt, window_ms), own_end + step_ms).alias("lo"),
                     (nxt - step_ms).alias("hi")),
            F.struct(F.when(F.col("prev_time").isNull(), bucket(t, window_ms)).alias("lo"),
                     (t - step_ms).alias("hi")))
    chunk = step_ms * 4096
    prices = ("open", "high", "low", "close", "volume")
    dense = (series.select("symbol", t.alias("t"), *prices, F.explode(spans).alias("s"))
             .select("symbol", "t", *prices, F.col("s.hi").alias("hi"),
                     F.explode(_grid(F.col("s.lo"), F.col("s.hi"), chunk)).alias("c0"))
             .select("symbol", "t", *prices, F.explode(_grid(
                 F.col("c0"), F.least(F.col("hi"), F.col("c0") + (chunk - step_ms)), step_ms))
                 .alias("open_time")))
    filled = F.col("open_time") != F.col("t")
    return dense.select(
        "symbol", "open_time",
        *[F.when(filled, F.col("close")).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low")],
        "close", F.when(filled, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
        filled.alias("is_filled"))


def roll_up_filled(candles: DataFrame, step_ms: int, window_ms: int) -> DataFrame:
    """Windowed roll-up of a gap-filled series with its count of real (traded) steps."""
    dense = gap_fill(candles, step_ms, window_ms)
    return (dense.groupBy("symbol", bucket("open_time", window_ms).alias("open_time"))
            .agg(*ohlc("open", "high", "low", "close", "open_time"),
                 F.round(F.sum("volume"), 8).alias("volume"),
                 F.count_if(F.col("volume") > 0).alias("real_count"),
                 F.count(F.lit(1)).alias("step_count")))


def as_of(probes: DataFrame, values: DataFrame, value: str, block_ms: int,
          time: str = "open_time") -> DataFrame:
    """Every probe row with the newest value of its symbol at or before its time."""
    both = (probes.withColumn("_side", F.lit(1)).unionByName(
        values.select("symbol", time, F.col(value), F.lit(0).alias("_side")), allowMissingColumns=True))
    found = with_carry(both, F.col(value), "_found", block_ms, [time, "_side"])
    return found.filter(F.col("_side") == 1).select(*probes.columns, F.col("_found").alias(value))


def interval_ms(label: str) -> int:
    """Milliseconds of a supported interval label, in any case and spacing."""
    known = label.strip().lower()
    if known not in INTERVAL_MS:
        raise ValueError(f"Unsupported interval: {known}")
    return INTERVAL_MS[known]
