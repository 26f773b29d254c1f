"""Key lookups: live enrichment, watchlists, metadata, tiers, range joins and trade sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import base_asset, bucket, ticker_color
from ..schemas import DAY_MS, MAX_TRADES, TICK_BLOCK_MS
from .blocks import trailing
from .candles import newest_bar
from .merge import dedup_price_volume, newest_n
from .sizing import small_side

BAR = ("open_time", "open", "high", "low", "close", "volume")


def _flat_bar(time: Column, price: Column) -> Column:
    """A bar with nothing but one price."""
    return F.struct(time.alias("open_time"), *[price.alias(c) for c in ("open", "high", "low", "close")],
                    F.lit(0.0).alias("volume"))


def _live_bar(base: str, price: Column) -> Column:
    """The bar with its close moved to the live price and its range widened to it."""
    bar = F.col(base)
    return F.struct(bar["open_time"].alias("open_time"), bar["open"].alias("open"),
                    F.greatest(bar["high"], price).alias("high"),
                    F.least(bar["low"], price).alias("low"), price.alias("close"),
                    bar["volume"].alias("volume"))


def enrich_with_live(candles: DataFrame, tickers: DataFrame, step_ms: int, now_ms: int) -> DataFrame:
    """Bring each symbol's newest bar up to its latest ticker.

    Same bucket, newer tick and window still open at ``now_ms``: close, high and low follow the
    price. A tick of a later bucket (or of a symbol without bars) adds a flat bar. What the tickers move is one
    row a symbol, so the bars stay where they are while those fit a broadcast.
    """
    newest = candles.groupBy("symbol").agg(F.max("open_time").alias("_newest"))
    live = tickers.select("symbol", F.col("price").alias("_price"), F.col("event_time").alias("_at"))
    live = live.filter(F.col("_price").isNotNull() & F.col("_at").isNotNull())
    known = (live.join(newest, "symbol", "left")
             .withColumn("_bucket", bucket("_at", step_ms)))
    added = (known.filter(F.col("_newest").isNull() | (F.col("_bucket") > F.col("_newest")))
             .select("symbol", _flat_bar(F.col("_bucket"), F.col("_price")).alias("_bar"))
             .select("symbol", "_bar.*"))
    touched = known.filter(
        (F.col("_newest") == F.col("_bucket")) & (F.col("_at") > F.col("_newest"))
        & (F.lit(now_ms) < F.col("_bucket") + step_ms)).select(
        "symbol", F.col("_bucket").alias("open_time"), "_price")
    joined = candles.select("symbol", *BAR).join(small_side(touched), ["symbol", "open_time"], "left")
    price = F.col("_price")
    moved = joined.select(
        "symbol", "open_time", "open",
        F.greatest("high", price).alias("high"), F.least("low", price).alias("low"),
        F.coalesce(price, "close").alias("close"), "volume")
    return moved.unionByName(added)


def pushed_bar(source: DataFrame, tickers: DataFrame, fallback: DataFrame, symbols: DataFrame,
               step_ms: int, now_ms: int, use_ticker: bool = True) -> DataFrame:
    """The bar a live feed pushes per symbol.

    It is the newest bar of the source candles; for five minutes and longer (``use_ticker``) a tick
    newer than the newest source candle moves it while its window is open, and a tick of a later
    window replaces it by a flat bar. Without source candles and ticks, the stored latest candle is
    re-bucketed. A stale tick never overrides.
    """
    bars = newest_bar(source, step_ms).select("symbol", F.struct(*BAR).alias("bar"), "source_time")
    last = fallback.select("symbol", F.struct(
        bucket("kline_start", step_ms).alias("open_time"), "open", "high", "low", "close",
        "volume").alias("stored"))
    rows = symbols.select("symbol").join(bars, "symbol", "left").join(last, "symbol", "left")
    if use_ticker:
        live = tickers.select("symbol", F.col("price").alias("_price"), F.col("event_time").alias("_at"))
        rows = rows.join(live, "symbol", "left")
        price, at, start = F.col("_price"), F.col("_at"), F.col("bar.open_time")
        window = bucket(at, step_ms)
        usable = (price != 0) & (at != 0)
        same = usable & (window == start)
        fresh = same & (at > F.col("source_time")) & (F.lit(now_ms) < start + step_ms)
        out = (F.when(fresh, _live_bar("bar", price))
               .when(same, F.col("bar"))
               .when(usable & (window > F.coalesce(start, F.lit(0).cast("bigint"))), _flat_bar(window, price))
               .otherwise(F.coalesce("bar", "stored")))
    else:
        out = F.col("bar")
    return rows.withColumn("_out", out).filter(F.col("_out").isNotNull()).select("symbol", "_out.*")


def refresh_watchlist(items: DataFrame, tickers: DataFrame) -> DataFrame:
    """Watchlist rows with the current price, change and colour; without a ticker they stay."""
    live = tickers.select("symbol", F.col("price").alias("_price"), F.col("change24h").alias("_change"),
                          F.lit(True).alias("_hit"))
    joined = items.join(live, "symbol", "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(
        "symbol", F.when(hit, F.col("_price")).otherwise(F.col("price")).alias("price"),
        F.coalesce("_change", "change").alias("change"),
        F.when(hit, ticker_color("_price", "_change", "color")).otherwise(F.col("color")).alias("color"))


def with_metadata(pairs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of the base asset, null when unknown.

    Base assets are few and hot, so the pairs stay where they are while the metadata fit a broadcast.
    """
    return pairs.withColumn("base", base_asset("symbol")).join(small_side(metadata), "base", "left")


def starred(items: DataFrame, stars: DataFrame) -> DataFrame:
    return items.join(stars.select("symbol"), "symbol", "left_semi")


def rows_in_ranges(ranges: DataFrame, rows: DataFrame, start: str, end: str, time: str,
                   cell_ms: int = DAY_MS) -> DataFrame:
    """Range join: rows of the same symbol with ``start <= time <= end``.

    Ranges are cut at cell borders, so the equi-join key is (symbol, cell) and one symbol or one
    long range spreads over many tasks.
    """
    cells = F.sequence(bucket(start, cell_ms), bucket(end, cell_ms), F.lit(cell_ms).cast("bigint"))
    cut = ranges.select("symbol", start, end, F.explode(cells).alias("_cell"))
    keyed = rows.withColumn("_cell", bucket(time, cell_ms))
    return (cut.join(keyed, ["symbol", "_cell"])
            .filter(F.col(time).between(F.col(start), F.col(end))).drop("_cell"))


def trade_sides(ticks: DataFrame, rule: str = "next", block_ms: int = TICK_BLOCK_MS,
                order=("event_time", "seq")) -> DataFrame:
    """Buy or sell side of every tick by comparing neighbouring prices.

    ``next`` compares with the next newer price and calls the newest tick a buy; ``tick`` is the
    conventional rule against the older neighbour, whose first tick is a buy.
    """
    rows = trailing(ticks, 1, block_ms, list(order),
                    {"_neighbour": lambda w: F.lag("price").over(w)}, reverse=rule == "next")
    side = (F.when(F.col("_neighbour").isNull() | (F.col("price") >= F.col("_neighbour")), F.lit("buy"))
            .otherwise(F.lit("sell")))
    return rows.withColumn("side", side).drop("_neighbour")


def recent_trades(ticks: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` price moves per symbol, from the (price, volume) history."""
    if not 1 <= limit <= MAX_TRADES:
        raise ValueError(f"limit must be between 1 and {MAX_TRADES}")
    history = newest_n(dedup_price_volume(ticks), limit, ("event_time", "seq"))
    return trade_sides(history).select("symbol", F.col("event_time").alias("time"), "price", "volume", "side")
