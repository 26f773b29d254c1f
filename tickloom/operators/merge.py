"""Deduplication, priority merge and upsert of candle and tick tables.

Everything is keyed by (symbol, time) or finer, so a hot symbol spreads over many groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..schemas import BLOCK_STEPS
from .blocks import trailing
from .candles import latest_write
from .sizing import small_side

KEY = ("symbol", "open_time")


def priority_merge(*tiers: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Union of the tiers by key; a later tier beats an earlier one."""
    tagged = [tier.withColumn("_rank", F.lit(rank)) for rank, tier in enumerate(tiers)]
    union = tagged[0]
    for tier in tagged[1:]:
        union = union.unionByName(tier)
    return latest_write(union, list(keys), "_rank").drop("_rank")


def best_by_volume(candles: DataFrame, seq: str = "seq") -> DataFrame:
    """One candle per second: the highest volume, the earliest of equals."""
    values = [c for c in candles.columns if c not in KEY and c != seq]
    best = candles.groupBy(*KEY).agg(
        F.max_by(F.struct(*values), F.struct(F.col("volume"), -F.col(seq))).alias("_row"))
    return best.select(*KEY, "_row.*")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows at the same key are replaced; ``incoming`` may repeat a key, its last ``seq`` wins."""
    rows = current.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(incoming)
    return latest_write(rows, list(keys), "seq").drop("seq")


def dedup_price_volume(ticks: DataFrame, order: str = "seq") -> DataFrame:
    """A repeated (price, volume) pair of a symbol keeps only its last written time."""
    return (ticks.groupBy("symbol", "price", "volume")
            .agg(F.max_by("event_time", F.col(order)).alias("event_time"), F.max(order).alias(order)))


def latest_per_symbol(df: DataFrame, order: str | Sequence[str]) -> DataFrame:
    return latest_write(df, ["symbol"], order)


def dedup_tickers(tickers: DataFrame) -> DataFrame:
    """One row per (symbol, event_time); of several, the last sequence number."""
    return latest_write(tickers, ["symbol", "event_time"], "seq")


def dedup_klines(klines: DataFrame) -> DataFrame:
    return latest_write(klines, ["symbol", "kline_start"], "seq")


def prepend_older(current: DataFrame, older: DataFrame) -> DataFrame:
    """Scroll-back: older rows strictly before the earliest current row, then the current ones."""
    first = current.groupBy("symbol").agg(F.min("open_time").alias("_first"))
    before = (older.join(small_side(first), "symbol").filter(F.col("open_time") < F.col("_first"))
              .drop("_first"))
    return before.unionByName(current)


def newest_n(df: DataFrame, n: int, order: str | Sequence[str] = "open_time") -> DataFrame:
    """The newest ``n`` rows per symbol; map tasks keep at most ``n`` each before the shuffle."""
    cols = [order] if isinstance(order, str) else list(order)
    w = W.partitionBy("symbol").orderBy(*[F.col(c).desc() for c in cols])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def poll_merge(current: DataFrame, polled: DataFrame, interval: str,
               max_bars: int | None = None) -> DataFrame:
    """Incremental poll: refresh changed bars, append newer ones; ``max_bars`` keeps only the newest.

    The newest bar of a minute-or-longer chart is left to the live feed. A polled bar that only
    fills a hole in the past is ignored, and so is one with nothing but a new open.
    """
    one_second = interval == "1s"
    values = ("open", "high", "low", "close", "volume")
    newest = current.groupBy("symbol").agg(F.max("open_time").alias("_newest"))
    old = current.select(*KEY, F.struct(*values).alias("old"))
    new = polled.select(*KEY, F.struct(*values).alias("new"))
    both = old.join(new, list(KEY), "full").join(small_side(newest), "symbol", "left")
    t, last = F.col("open_time"), F.col("_newest")
    changed = F.lit(False)
    for c in ("close", "high", "low", "volume"):
        changed = changed | (F.col(f"old.{c}") != F.col(f"new.{c}"))
    authoritative = F.lit(one_second) | (t < last)
    row = (F.when(F.col("old").isNull(), F.when(last.isNull() | (t > last), F.col("new")))
           .when(F.col("new").isNotNull() & changed & authoritative, F.col("new"))
           .otherwise(F.col("old")))
    merged = both.select(*KEY, row.alias("_row")).filter(F.col("_row").isNotNull())
    bars = merged.select(*KEY, "_row.*")
    return bars if max_bars is None else newest_n(bars, max_bars)


def apply_live(current: DataFrame, live: DataFrame, interval: str,
               max_bars: int | None = None) -> DataFrame:
    """Apply one pushed candle per symbol: 1s only appends; longer bars also replace the newest.

    ``max_bars`` keeps only the newest bars of a symbol.
    """
    one_second = interval == "1s"
    newest = current.groupBy("symbol").agg(F.max("open_time").alias("_newest"))
    t, last = F.col("open_time"), F.col("_newest")
    accepted = (live.join(newest, "symbol")
                .filter(t > last if one_second else t >= last).drop("_newest"))
    bars = priority_merge(current, accepted)
    return bars if max_bars is None else newest_n(bars, max_bars)


def change_only(rows: DataFrame, order: str, block_ms: int | None = None) -> DataFrame:
    """Rows that differ in any value from the row before them."""
    values = [c for c in rows.columns if c not in ("symbol", order)]
    block_ms = block_ms or 60_000 * BLOCK_STEPS
    flagged = trailing(rows, 1, block_ms, [order], {
        "_first": lambda w: F.row_number().over(w) == 1,
        "_same": lambda w: F.struct(*values).eqNullSafe(F.lag(F.struct(*values)).over(w))})
    return flagged.filter(F.col("_first") | ~F.col("_same")).drop("_first", "_same")


def override_metadata(fallback: DataFrame, fresh: DataFrame) -> DataFrame:
    """Symbol metadata by base asset; fresh entries override the fallback ones."""
    return priority_merge(fallback, fresh, keys=["base"])


def only_new(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, each key once: a rerun appends nothing."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
