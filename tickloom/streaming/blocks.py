"""Stateful streaming by blocks: the rows of a micro-batch meet the state of the former one in the block-parallel batch operators.

A keyed stateful operator holds all rows of a symbol in one process. Here a micro-batch is cut into (symbol, block) pieces, pieces are
reduced in parallel, composed per symbol from the state the former micro-batch left, and replayed in parallel, so a
symbol with nearly all rows spreads over all tasks. State is a table of one row per symbol and micro-batch; it is written with the
results and marked whole together with them, so a repeated micro-batch starts from the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.blocks import trailing
from ..operators.indicators import ema_of, mean_of_last, smooth
from ..operators.merge import newest_n
from ..operators.normalize import closed_minutes
from ..operators.throttle import throttle
from ..schemas import BLOCK_STEPS, HEARTBEAT_MS, MINUTE_MS
from ..session import fresh_dir
from ..sources import sinks

#: rows, state before -> results, state after.
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
KEPT_STATES = 2
THROTTLE_STATE = "symbol string, price double, sent_at bigint"
INDICATOR_STATE = "symbol string, open_time bigint, ema12 double, ema26 double, closes array<struct<open_time:bigint,close:double>>"


def run_in_blocks(stream: DataFrame, step: Step, state_schema: str, out: str, state: str, checkpoint: str, **options):
    """Start a query whose micro-batches go through ``step``; results and states are read with ``sinks.read_committed``."""
    spark = stream.sparkSession
    schema = T.StructType.fromDDL(state_schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = [n for n in sinks.committed(session, state) if n < batch_id]
        before = sinks.read_committed(session, state, schema, known[-1:])
        rows = _stored(session, batch, f"blocks-{batch_id}")
        results, after = step(rows, before)
        sinks.write_batch(results, batch_id, out)
        sinks.write_batch(after, batch_id, state)
        sinks.commit_batch(session, batch_id, out)
        sinks.commit_batch(session, batch_id, state)
        sinks.forget_batches(session, state, known[:-KEPT_STATES])

    return sinks.foreach_batch(stream, write, checkpoint, **options)


def _stored(spark: SparkSession, batch: DataFrame, label: str) -> DataFrame:
    """The micro-batch in the shared folder: several plans read it, and a lost executor must not make the source be read again."""
    path = fresh_dir(spark, label)
    batch.write.parquet(path)
    return spark.read.schema(batch.schema).parquet(path)


def throttle_step(heartbeat_ms: int = HEARTBEAT_MS, block_ms: int | None = None) -> Step:
    """Ticks sent on change or heartbeat; carries each symbol's last price and the time of its last sent tick."""
    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        judged = _stored(rows.sparkSession, throttle(rows, heartbeat_ms, block_ms, before), "throttled")
        last = judged.groupBy("symbol").agg(F.max_by("price", "seq").alias("price"), F.max(F.when(F.col("reason") != "skipped", F.col("event_time"))).alias("sent"))
        after = (before.join(last.withColumnRenamed("price", "newer"), "symbol", "full")
                 .select("symbol", F.when(F.col("newer").isNotNull(), F.col("newer")).otherwise(F.col("price")).alias("price"),
                         F.coalesce("sent", "sent_at").alias("sent_at")))
        return judged.filter("reason <> 'skipped'").select("symbol", "seq", "event_time", "price", "reason"), after
    return step


def indicator_step(step_ms: int = MINUTE_MS, longest: int = 50) -> Step:
    """SMA and EMA of closed candles; carries each symbol's last closes and its two running averages.

    A micro-batch holds candles later than those before it.
    """
    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        closed = closed_minutes(rows).select("symbol", F.col("kline_start").alias("open_time"), "close")
        new = closed.withColumn("fresh", F.lit(True))
        held = before.select("symbol", F.inline("closes")).withColumn("fresh", F.lit(False))
        means = trailing(held.unionByName(new), longest - 1, step_ms * BLOCK_STEPS, ["open_time"], {
            "sma20": lambda w: mean_of_last("close", 20, w), "sma50": lambda w: mean_of_last("close", 50, w)}).filter("fresh")
        # The averages go on from one row per symbol that stands for all before.
        series = closed.select("symbol", "open_time", F.col("close").alias("x12"), F.col("close").alias("x26"), F.lit(True).alias("fresh")).unionByName(
            before.select("symbol", "open_time", F.col("ema12").alias("x12"), F.col("ema26").alias("x26"), F.lit(False).alias("fresh")))
        smoothed = smooth(series, [ema_of("ema12", "x12", 12), ema_of("ema26", "x26", 26)], step_ms).filter("fresh")
        both = _stored(rows.sparkSession, means.drop("fresh").join(smoothed.select("symbol", "open_time", "ema12", "ema26"), ["symbol", "open_time"]), "indicators")
        last = both.groupBy("symbol").agg(F.max_by(F.struct("open_time", "ema12", "ema26"), "open_time").alias("now"))
        tail = newest_n(held.drop("fresh").unionByName(closed), longest - 1)
        closes = tail.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("open_time", "close"))).alias("closes"))
        was = before.select("symbol", F.struct("open_time", "ema12", "ema26").alias("was"))
        after = (closes.join(last, "symbol", "left").join(was, "symbol", "left")
                 .select("symbol", F.coalesce("now", "was").alias("s"), "closes").select("symbol", "s.*", "closes"))
        return both.select("symbol", F.col("open_time").alias("timestamp"), "sma20", "sma50", "ema12", "ema26", "close"), after
    return step
