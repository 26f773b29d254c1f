"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir

BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A one-row-per-key table, computed once and broadcast only if it turned out small.

    The table is checkpointed in the shared folder, so it survives lost executors and its size is
    known. Beyond ``max_rows`` it is left to a shuffled join, where adaptive execution splits hot
    keys.
    """
    shared_dir(df.sparkSession)
    done = df.checkpoint()
    return F.broadcast(done) if done.count() <= max_rows else done
