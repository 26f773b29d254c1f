"""Ordered per-symbol computation that does not need a whole symbol in one task.

A window partitioned by symbol alone puts a hot symbol into one task. Here the window is
partitioned by (symbol, time block) and the little that must cross a block border is computed
from a per-block summary, which has at most one row (or ``n`` rows) per symbol and block:

* ``with_halo`` copies the ``n`` rows before each block into it, so that every trailing ROWS
  frame of at most ``n`` preceding rows is exact, however sparse the series is;
* ``with_row_index`` numbers the rows of a symbol from the row counts of earlier blocks;
* ``with_carry`` brings in the last known value from before the block.

Results do not depend on the block length; it only sets the size of the work units.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import bucket

BLOCK, HALO, RN = "_block", "_halo", "_rn"
BEFORE = (W.unboundedPreceding, -1)


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def block_window(order: Sequence[str], key="symbol", reverse: bool = False):
    cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    return W.partitionBy(*_keys(key), BLOCK).orderBy(*cols)


def fit_block(df: DataFrame, time: str, candidates: Sequence[int], rows: int, key="symbol") -> int:
    """The longest candidate block that keeps every (symbol, block) within ``rows`` rows.

    For operators that hold a block in Python memory. One job over counts per shortest block; if
    even those are too full, the shortest block is returned.
    """
    lengths = sorted(candidates)
    fine = df.groupBy(*_keys(key), bucket(time, lengths[0]).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    fullest = None
    for length in lengths:
        sizes = (fine.groupBy(*_keys(key), bucket("_t", length)).agg(F.sum("_n").alias("_n"))
                 .agg(F.max("_n").alias("n")).select(F.lit(length).alias("length"), "n"))
        fullest = sizes if fullest is None else fullest.unionByName(sizes)
    fitting = [r["length"] for r in fullest.collect() if r["n"] is None or r["n"] <= rows]
    return max(fitting, default=lengths[0])


def with_halo(df: DataFrame, n: int, block_ms: int, order: Sequence[str], key="symbol",
              reverse: bool = False) -> DataFrame:
    """Add ``_block`` and, flagged ``_halo``, the ``n`` rows preceding each block.

    ``order[0]`` is the time in milliseconds. With ``reverse`` the series is read backwards, so
    the halo holds the ``n`` rows that follow the block.
    """
    base = df.withColumn(BLOCK, bucket(order[0], block_ms))
    if n == 1 and len(order) == 1:
        # One edge row per block: a map-side combined aggregate instead of a sort.
        pick, extreme = (F.min_by, F.min) if reverse else (F.max_by, F.max)
        rest = [c for c in base.columns if c not in (*_keys(key), BLOCK, order[0])]
        edges = base.groupBy(*_keys(key), BLOCK).agg(
            extreme(order[0]).alias(order[0]), *[pick(c, F.col(order[0])).alias(c) for c in rest])
    else:
        away = block_window(order, key, reverse=not reverse)
        edges = base.withColumn(RN, F.row_number().over(away)).filter(F.col(RN) <= n).drop(RN)
    cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    along = W.partitionBy(*_keys(key)).orderBy(*cols)
    starts = edges.withColumn(
        "_start", F.when(~F.col(BLOCK).eqNullSafe(F.lag(BLOCK).over(along)), F.col(BLOCK)))
    halo = (starts
            .withColumn("_targets", F.collect_list("_start").over(along.rowsBetween(1, n)))
            .drop(BLOCK, "_start")
            .withColumn(BLOCK, F.explode("_targets"))
            .drop("_targets"))
    return base.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))


def trailing(df: DataFrame, n: int, block_ms: int, order: Sequence[str],
             exprs: dict[str, Callable], key="symbol", reverse: bool = False) -> DataFrame:
    """Add window columns reaching at most ``n`` rows back (or ahead with ``reverse``).

    Each entry of ``exprs`` maps an output name to a function of the window; the entries are
    evaluated in order, so later ones may use earlier columns at their own row.
    """
    w = block_window(order, key, reverse)
    out = with_halo(df, n, block_ms, order, key, reverse)
    for name, build in exprs.items():
        out = out.withColumn(name, build(w))
    return out.filter(~F.col(HALO)).drop(BLOCK, HALO)


def with_row_index(df: DataFrame, block_ms: int, order: Sequence[str], key="symbol",
                   stats: dict[str, Column] | None = None, keep: bool = False) -> DataFrame:
    """Add ``row_index`` (1-based within the symbol), ``row_count`` and whole-symbol ``stats``.

    ``stats`` maps names to ``min``/``max`` aggregates; they are folded per block first. With
    ``keep`` the block columns stay for further use.
    """
    keys = _keys(key)
    stats = stats or {}
    base = df.withColumn(BLOCK, bucket(order[0], block_ms))
    summary = base.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("_n"), *[agg.alias(name) for name, agg in stats.items()])
    whole = W.partitionBy(*keys)
    folds = [(F.max if name.startswith("max") else F.min)(name).over(whole).alias(name)
             for name in stats]
    offsets = summary.select(
        *keys, BLOCK,
        F.coalesce(F.sum("_n").over(whole.orderBy(BLOCK).rowsBetween(*BEFORE)), F.lit(0)).alias("_off"),
        F.sum("_n").over(whole).alias("row_count"), *folds)
    out = (base.withColumn(RN, F.row_number().over(block_window(order, key)))
           .join(offsets, [*keys, BLOCK])
           .withColumn("row_index", F.col("_off") + F.col(RN)))
    return out if keep else out.drop(BLOCK, RN, "_off")


def with_carry(df: DataFrame, value: Column, name: str, block_ms: int, order: Sequence[str],
               key="symbol") -> DataFrame:
    """Add the latest non-null ``value`` at or before each row."""
    keys = _keys(key)
    position = F.struct(*order)
    base = df.withColumn(BLOCK, bucket(order[0], block_ms)).withColumn("_value", value)
    summary = base.groupBy(*keys, BLOCK).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), position)).alias("_last"))
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(*BEFORE)
    carried = summary.select(
        *keys, BLOCK, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    running = block_window(order, key).rowsBetween(W.unboundedPreceding, 0)
    return (base.withColumn("_local", F.last("_value", ignorenulls=True).over(running))
            .join(carried, [*keys, BLOCK])
            .withColumn(name, F.coalesce("_local", "_carry"))
            .drop(BLOCK, "_value", "_local", "_carry"))
