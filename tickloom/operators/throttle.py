"""Change-or-heartbeat throttle of a ticker series.

A row is sent when its price differs from the row before it (a skipped row always repeats the sent
price, so comparing neighbours is enough) or when at least ``heartbeat_ms`` passed since the last
sent row. The heartbeat is a greedy walk, so its only state is the time of the last sent row.

The walk is cut into (symbol, block) pieces. A block maps the incoming state to the outgoing one;
the incoming state only decides which of the block's leading rows is sent first, and any price
change forgets it, so the map is a short table. Tables are composed per symbol, then all blocks
are replayed in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import bucket
from ..schemas import DAY_MS, HEARTBEAT_MS, HOUR_MS, MINUTE_MS
from .blocks import BLOCK, fit_block, trailing
from .sizing import small_side

BLOCK_CHOICES = (MINUTE_MS, HOUR_MS, DAY_MS, 30 * DAY_MS)
BLOCK_ROWS = 500_000
NEVER = -(2 ** 62)


def _next_sent(times: np.ndarray, changed: np.ndarray, heartbeat_ms: int) -> np.ndarray:
    """For each row, if it is sent: the position of the next sent row (len = none)."""
    n = len(times)
    due = np.searchsorted(times, times + heartbeat_ms, side="left")
    marks = np.append(np.flatnonzero(changed), n)
    change = marks[np.searchsorted(marks, np.arange(n), side="right")]
    return np.minimum(np.maximum(due, np.arange(1, n + 1)), change)


def _chain_ends(jump: np.ndarray) -> np.ndarray:
    """Last row of the chain of sent rows that starts at each row, by doubling the jumps."""
    end = np.where(jump >= len(jump), np.arange(len(jump)), jump)
    while True:
        further = end[end]
        if (further == end).all():
            return end
        end = further


def _chain(jump: np.ndarray, start: int) -> np.ndarray:
    """Rows of the chain that starts at ``start`` (and the end mark), by doubling the jumps."""
    hop, rows = np.append(jump, len(jump)), np.array([start])
    while rows[-1] < len(jump):
        rows, hop = np.concatenate((rows, hop[rows])), hop[hop]
    return rows


def _block_maps(heartbeat_ms: int):
    """Reduce a block to: exit state per first sent row that some incoming state can lead to."""
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        times, changed = rows["event_time"].to_numpy(), rows["changed"].to_numpy()
        n, jump = len(times), _next_sent(times, changed, heartbeat_ms)
        last = times[_chain_ends(jump)]
        first_change = int(np.argmax(changed)) if changed.any() else n
        # Incoming state is older than the block, so a row at or beyond block start + heartbeat
        # is always due; rows with equal times are reached through the first of them only.
        reach = min(first_change + 1, int(np.searchsorted(times, times[0] + heartbeat_ms)) + 1, n)
        new = np.concatenate(([True], times[1:reach] > times[:reach - 1]))
        firsts = np.flatnonzero(new | (np.arange(reach) == first_change))
        # Neighbouring entries with the same exit collapse into the last of them.
        firsts = firsts[np.append(last[firsts[1:]] != last[firsts[:-1]], True)]
        return pd.DataFrame({
            "symbol": rows["symbol"].iloc[0], BLOCK: rows[BLOCK].iloc[0],
            "first_time": times[firsts], "forced": firsts == first_change, "exit_time": last[firsts]})
    return reduce


def _compose(heartbeat_ms: int):
    """Walk the block tables of a symbol in time order; gives each block its incoming state."""
    def compose(maps: pd.DataFrame) -> pd.DataFrame:
        maps = maps.sort_values([BLOCK, "first_time", "forced"])
        blocks, entries, state, leaving = [], [], NEVER, NEVER
        current, found = None, False
        for block, first, forced, exit_time in zip(
                *(maps[c].tolist() for c in (BLOCK, "first_time", "forced", "exit_time"))):
            if block != current:
                current, found, state = block, False, leaving
                blocks.append(block)
                entries.append(state)
            if not found and (forced or first - heartbeat_ms >= state):
                leaving, found = exit_time, True
        return pd.DataFrame({"symbol": maps["symbol"].iloc[0], BLOCK: blocks, "entry_time": entries})
    return compose


def _replay(heartbeat_ms: int):
    def replay(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = left.sort_values("seq")
        times, changed = rows["event_time"].to_numpy(), rows["changed"].to_numpy()
        n, jump = len(times), _next_sent(times, changed, heartbeat_ms)
        start = int(np.searchsorted(times, int(right["entry_time"].iloc[0]) + heartbeat_ms))
        if changed.any():
            start = min(start, int(np.argmax(changed)))
        sent = np.zeros(n + 1, dtype=bool)
        sent[_chain(jump, min(start, n))] = True
        sent = sent[:n]
        reason = np.where(changed, "change", np.where(sent, "heartbeat", "skipped"))
        return pd.DataFrame({"symbol": rows["symbol"], "seq": rows["seq"],
                             "event_time": rows["event_time"], "price": rows["price"], "reason": reason})
    return replay


def throttle(ticks: DataFrame, heartbeat_ms: int = HEARTBEAT_MS,
             block_ms: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """Every tick with its ``reason``: change, heartbeat or skipped.

    ``seq`` is unique within a symbol and ascends with ``event_time``. Without ``block_ms`` the
    block is the longest whose rows fit ``BLOCK_ROWS``; the result is the same for any length.
    ``start`` is what earlier ticks left behind: (symbol, price, sent_at) of the last tick and the last one sent.
    """
    rows = ticks.select("symbol", "event_time", "seq", "price")
    if block_ms is None:
        block_ms = fit_block(rows, "event_time", BLOCK_CHOICES, BLOCK_ROWS)
    flagged = trailing(rows, 1, block_ms, ["event_time", "seq"], {
        "_before": lambda w: F.lag("price").over(w), "_first": lambda w: F.lag("seq").over(w).isNull()})
    if start is not None:
        prices = small_side(start.select("symbol", F.col("price").alias("_carried")))
        flagged = flagged.join(prices, "symbol", "left").withColumn("_before", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))).drop("_carried")
    flagged = flagged.withColumn("changed", ~F.col("price").eqNullSafe(F.col("_before"))).drop("_before", "_first")
    # Both uses take all columns, so the rows are dealt to their blocks once.
    flagged = flagged.withColumn(BLOCK, bucket("event_time", block_ms))
    table = f"symbol string, {BLOCK} bigint, first_time bigint, forced boolean, exit_time bigint"
    maps = flagged.groupBy("symbol", BLOCK).applyInPandas(_block_maps(heartbeat_ms), table)
    if start is not None:
        # A block before all others that always ends with the carried state.
        maps = maps.unionByName(start.select("symbol", F.lit(NEVER).alias(BLOCK), F.lit(NEVER).alias("first_time"), F.lit(True).alias("forced"),
                                             F.col("sent_at").alias("exit_time")))
    entries = maps.groupBy("symbol").applyInPandas(
        _compose(heartbeat_ms), f"symbol string, {BLOCK} bigint, entry_time bigint").filter(F.col(BLOCK) > NEVER)
    return (flagged.groupBy("symbol", BLOCK).cogroup(entries.groupBy("symbol", BLOCK))
            .applyInPandas(_replay(heartbeat_ms),
                           "symbol string, seq bigint, event_time bigint, price double, reason string"))


def sent_only(throttled: DataFrame) -> DataFrame:
    return throttled.filter(F.col("reason") != "skipped")


def ingest_accounting(throttled: DataFrame) -> DataFrame:
    """Counts of rows sent on change, sent as heartbeat, and skipped."""
    return throttled.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
