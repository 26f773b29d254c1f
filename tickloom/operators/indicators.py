"""Technical indicators over candles: SMA, EMA, RSI, MFI and the per-candle indicator row.

Moving averages and money flow are trailing ROWS frames. EMA and Wilder smoothing are the affine
recursion ``e' = (1 - a) * e + a * x``; affine maps compose, so each (symbol, block) is reduced to
one map, the few maps of a symbol are composed in order, and every block is then replayed from its
own start value. Only the composition is sequential, over one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import half_up
from ..schemas import BLOCK_STEPS
from .blocks import BLOCK, RN, block_window, trailing, with_row_index


def mean_of_last(value: str, n: int, w) -> Column:
    """Mean over the last ``n`` rows, null until there are ``n``."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def sma(candles: DataFrame, periods: Sequence[int], step_ms: int) -> DataFrame:
    """``sma<n>`` for each period, one pass for all."""
    rows = candles.select("symbol", "open_time", "close")
    exprs = {f"sma{n}": (lambda w, n=n: mean_of_last("close", n, w)) for n in periods}
    return trailing(rows, max(periods) - 1 or 1, step_ms * BLOCK_STEPS, ["open_time"], exprs)


@dataclass(frozen=True)
class Smoothing:
    """One affine recursion over ``source``; its first ``seed_rows`` values are averaged."""

    name: str
    source: str
    alpha: float
    seed_rows: int = 1


def ema_of(name: str, source: str, period: int, seed: str = "first") -> Smoothing:
    return Smoothing(name, source, 2.0 / (period + 1), period if seed == "sma" else 1)


def wilder_of(name: str, source: str, period: int) -> Smoothing:
    return Smoothing(name, source, 1.0 / period, period)


def _compose_blocks(specs: Sequence[Smoothing]):
    def compose(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(BLOCK)
        for i, spec in enumerate(specs):
            state, starts = 0.0, []
            for count, total in zip(blocks[f"_c{i}"], blocks[f"_s{i}"]):
                starts.append(state)
                state = (1.0 - spec.alpha) ** count * (state + total)
            blocks[f"_e{i}"] = starts
        return blocks[["symbol", BLOCK, *[f"_e{i}" for i in range(len(specs))]]]
    return compose


def smooth(series: DataFrame, specs: Sequence[Smoothing], step_ms: int) -> DataFrame:
    """Add one column per recursion; null before its seed is complete.

    A time block with more than ``BLOCK_STEPS`` rows (repeated steps) is cut further by row number,
    which keeps the scaled weights ``(1 - a) ** -c`` far from overflow.
    """
    rows = with_row_index(series, step_ms * BLOCK_STEPS, ["open_time"], keep=True)
    # A block's time is a multiple of its length, so the small number of the cut keeps the order.
    rows = (rows.withColumn(BLOCK, F.col(BLOCK) + F.floor((F.col(RN) - 1) / BLOCK_STEPS))
            .withColumn(RN, (F.col(RN) - 1) % BLOCK_STEPS + 1))
    index, recursive = F.col("row_index"), []
    for i, spec in enumerate(specs):
        x = F.col(spec.source)
        if spec.alpha >= 1.0:
            rows = rows.withColumn(f"_c{i}", F.lit(0)).withColumn(f"_w{i}", F.lit(0.0))
            continue
        recursive.append(i)
        applied = F.greatest(F.lit(0), F.least(F.col(RN), index - spec.seed_rows))
        rows = (rows.withColumn(f"_c{i}", applied.cast("int"))
                .withColumn(f"_w{i}", F.when(index <= spec.seed_rows, x / spec.seed_rows)
                            .otherwise(x * spec.alpha * F.pow(F.lit(1.0 - spec.alpha), -F.col(f"_c{i}")))))
    summary = rows.groupBy("symbol", BLOCK).agg(
        *[F.max(f"_c{i}").alias(f"_c{i}") for i in range(len(specs))],
        *[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(len(specs))])
    schema = f"symbol string, {BLOCK} bigint, " + ", ".join(f"_e{i} double" for i in range(len(specs)))
    starts = summary.groupBy("symbol").applyInPandas(_compose_blocks(specs), schema)
    running = block_window(["row_index"]).rowsBetween(W.unboundedPreceding, 0)
    sums = rows.select("*", *[F.sum(f"_w{i}").over(running).alias(f"_r{i}") for i in recursive])
    out = sums.join(starts, ["symbol", BLOCK])
    values = []
    for i, spec in enumerate(specs):
        value = (F.pow(F.lit(1.0 - spec.alpha), F.col(f"_c{i}")) * (F.col(f"_e{i}") + F.col(f"_r{i}"))
                 if i in recursive else F.col(spec.source))
        values.append(F.when(index >= spec.seed_rows, value).alias(spec.name))
    return out.select(*series.columns, "row_index", *values)


def ema(candles: DataFrame, periods: Sequence[int], step_ms: int, seed: str = "first") -> DataFrame:
    """``ema<n>`` per period, seeded with the first close or the mean of the first ``n``."""
    rows = candles.select("symbol", "open_time", "close")
    return smooth(rows, [ema_of(f"ema{n}", "close", n, seed) for n in periods], step_ms).drop("row_index")


def rsi(candles: DataFrame, period: int, step_ms: int) -> DataFrame:
    """Wilder RSI, from the ``period``-th price change on; 100 while there is no loss."""
    rows = candles.select("symbol", "open_time", "close")
    moves = trailing(rows, 1, step_ms * BLOCK_STEPS, ["open_time"],
                     {"_move": lambda w: F.col("close") - F.lag("close").over(w)})
    moves = moves.filter(F.col("_move").isNotNull()).select(
        "symbol", "open_time",
        F.greatest(F.col("_move"), F.lit(0.0)).alias("gain"),
        F.greatest(-F.col("_move"), F.lit(0.0)).alias("loss"))
    averages = smooth(moves, [wilder_of("avg_gain", "gain", period),
                              wilder_of("avg_loss", "loss", period)], step_ms)
    ratio = F.col("avg_gain") / F.col("avg_loss")
    value = F.when(F.col("avg_loss") == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio))
    return (averages.filter(F.col("avg_gain").isNotNull())
            .select("symbol", "open_time", "avg_gain", "avg_loss", value.alias("rsi")))


def mfi(candles: DataFrame, period: int, step_ms: int) -> DataFrame:
    """Money flow index over the last ``period`` changes; 100 while nothing flowed out."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = candles.select("symbol", "open_time", typical.alias("tp"),
                          (typical * F.col("volume")).alias("flow"))
    # The oldest change of a frame needs one more row before the frame, hence a halo of `period`.
    frame = lambda w: w.rowsBetween(-(period - 1), 0)
    flows = trailing(rows, period, step_ms * BLOCK_STEPS, ["open_time"], {
        "_previous": lambda w: F.lag("tp").over(w),
        "_n": lambda w: F.count("_previous").over(frame(w)),
        "_in": lambda w: F.sum(F.when(F.col("tp") >= F.col("_previous"), F.col("flow"))
                               .otherwise(F.lit(0.0))).over(frame(w)),
        "_out": lambda w: F.sum(F.when(F.col("tp") < F.col("_previous"), F.col("flow"))
                                .otherwise(F.lit(0.0))).over(frame(w))})
    value = F.when(F.col("_out") == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.col("_in") / F.col("_out")))
    return (flows.filter(F.col("_n") == period)
            .select("symbol", "open_time", value.alias("mfi")))


def indicator_rows(klines: DataFrame, step_ms: int) -> DataFrame:
    """One row per closed candle: sma20, sma50, ema12, ema26 and the close."""
    closed = klines.filter(F.col("is_closed")).select(
        "symbol", F.col("kline_start").alias("open_time"), "close")
    averages = trailing(closed, 49, step_ms * BLOCK_STEPS, ["open_time"], {
        "sma20": lambda w: mean_of_last("close", 20, w),
        "sma50": lambda w: mean_of_last("close", 50, w)})
    return (smooth(averages, [ema_of("ema12", "close", 12), ema_of("ema26", "close", 26)], step_ms)
            .select("symbol", F.col("open_time").alias("timestamp"), "sma20", "sma50", "ema12",
                    "ema26", "close"))


def chart_value(column: str, digits: int = 4) -> Column:
    """An indicator as charts show it."""
    return half_up(column, digits)
