"""Bucketing, gaps, indicators and other ordered computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import candles as C, indicators as I, reshape as R
from ..operators.blocks import with_row_index
from ..operators.lookup import trade_sides
from ..operators.merge import latest_per_symbol, newest_n
from ..operators.throttle import ingest_accounting, sent_only, throttle
from ..schemas import BLOCK_STEPS, DAY_MS, HOUR_MS, INTERVAL_MS, LISTING_EPOCH_MS, MINUTE_MS
from ..session import fresh_dir
from ..sources import tables as tb
from .ingest import all_klines
from .registry import OHLCV, query, with_views

WEEK_MS = INTERVAL_MS["1w"]


def _resampled_sql(source: str, step: int, views: str = "") -> str:
    return with_views(views or source, f"""SELECT symbol, open_time - open_time % {step} AS open_time,
        arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low,
        arg_max(close, open_time) AS close, sum(volume) AS volume FROM {source} GROUP BY 1, 2""".replace(
        "open_time - open_time %", f"{source}.open_time - {source}.open_time %").replace(
        ", open_time)", f", {source}.open_time)"))


def _resample(label: str):
    step = INTERVAL_MS[label]

    @query(f"resample_1m_to_{label}", "A1", _resampled_sql("c1m", step))
    def _(spark, d):
        return C.resample(tb.candles(spark, d, MINUTE_MS), step)


for _label in ("5m", "15m", "1h", "4h", "1d", "1w"):
    _resample(_label)


def _line_sql(step: int) -> str:
    return with_views("ticks_big", f"""SELECT symbol, event_time - event_time % {step} AS open_time,
        arg_min(price, row(event_time, l_orderkey, l_linenumber, l_partkey)) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, row(event_time, l_orderkey, l_linenumber, l_partkey)) AS close,
        sum(volume) AS volume, count(*) AS trade_count FROM ticks_big GROUP BY 1, 2""")


@query("supplier_candles_1d", "A1 A3", _line_sql(DAY_MS))
def _(spark, d):
    return C.candles_from_ticks(tb.ticks_big(spark, d), DAY_MS).drop("quote_volume")


@query("supplier_candles_1w", "A1 A3", _line_sql(WEEK_MS))
def _(spark, d):
    return C.candles_from_ticks(tb.ticks_big(spark, d), WEEK_MS).drop("quote_volume")


@query("order_candles_1w", "A1 A3", with_views("order_ticks", f"""SELECT symbol,
    event_time - event_time % {WEEK_MS} AS open_time, arg_min(price, (event_time, seq)) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, (event_time, seq)) AS close, sum(volume) AS volume, count(*) AS trade_count
    FROM order_ticks GROUP BY 1, 2"""))
def _(spark, d):
    return C.candles_from_ticks(tb.order_ticks(spark, d), WEEK_MS).drop("quote_volume")


@query("ohlcv_1h", "A3", with_views("c1h", f"""SELECT {OHLCV}, round(quote_volume, 4) AS quote_volume,
    trade_count FROM c1h"""))
def ohlcv_1h(spark, d):
    bars = C.candles_from_ticks(tb.ticks(spark, d), HOUR_MS)
    return bars.withColumn("quote_volume", F.round("quote_volume", 4))


@query("user_candles_1d", "A3", with_views("ticks_many", f"""SELECT symbol, event_time - event_time % {DAY_MS} AS open_time,
    arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
    sum(volume) AS volume FROM ticks_many GROUP BY 1, 2"""))
def _(spark, d):
    return C.candles_from_ticks(tb.ticks_many(spark, d), DAY_MS).select(*C.CANDLE_COLS)


@query("seconds_to_minutes", "A2 D8", with_views("k1s", """SELECT symbol, kline_start - kline_start % 60000 AS kline_start,
    kline_start - kline_start % 60000 + 59999 AS kline_close, '1m' AS "interval",
    arg_min(open, k1s.kline_start) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, k1s.kline_start) AS close, sum(volume) AS volume, round(sum(quote_volume), 4) AS quote_volume,
    CAST(sum(trade_count) AS BIGINT) AS trade_count, true AS is_closed FROM k1s GROUP BY 1, 2, 3""".replace(
    "kline_start - kline_start %", "k1s.kline_start - k1s.kline_start %")))
def _(spark, d):
    seconds = tb.klines(spark, d, "1s", 1000)
    # An earlier draft of every second (half its volume) must lose against the final one.
    draft = seconds.withColumn("event_time", F.col("event_time") - 500).withColumn("volume", F.col("volume") / 2)
    rolled = C.roll_up_seconds(draft.unionByName(seconds))
    return rolled.withColumn("quote_volume", F.round("quote_volume", 4))


@query("open_bucket_candle", "A4", with_views("c1m", f"""SELECT symbol, bucket AS open_time,
    arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close,
    sum(volume) AS volume, max(open_time) AS source_time
    FROM (SELECT *, open_time - open_time % {4 * HOUR_MS} AS bucket,
          max(open_time) OVER (PARTITION BY symbol) AS newest FROM c1m)
    WHERE bucket = newest - newest % {4 * HOUR_MS} GROUP BY symbol, bucket"""))
def _(spark, d):
    return C.newest_bar(tb.candles(spark, d, MINUTE_MS), 4 * HOUR_MS)


_POINTS = """SELECT symbol, event_time - event_time % 60000 + 60000 AS time, arg_max(price, seq) AS price
    FROM ticks GROUP BY 1, 2"""


@query("last_price_per_minute", "A5", with_views("ticks", _POINTS))
def _(spark, d):
    return C.last_per_step(tb.ticks(spark, d))


def _listed(spark, d) -> DataFrame:
    """Symbols plus one that was never traded."""
    extra = spark.createDataFrame([("NEWUSDT",)], "symbol string")
    return tb.symbols(spark, d).select("symbol").unionByName(extra)


@query("high_watermarks", "A6", with_views("k1s k1m symbols", f"""SELECT s.symbol,
    coalesce(max(k.kline_start) + 60000, {LISTING_EPOCH_MS}) AS start_ms
    FROM (SELECT symbol FROM symbols UNION ALL SELECT 'NEWUSDT') s
    LEFT JOIN (SELECT * FROM k1m UNION ALL SELECT * FROM k1s) k ON k.symbol = s.symbol AND k."interval" = '1m'
    GROUP BY s.symbol"""))
def _(spark, d):
    return C.high_watermarks(_listed(spark, d), all_klines(spark, d))


@query("first_available", "A7", with_views("k1m symbols", f"""SELECT s.symbol,
    coalesce(min(kline_start), {LISTING_EPOCH_MS}) AS start_ms
    FROM (SELECT symbol FROM symbols UNION ALL SELECT 'NEWUSDT') s LEFT JOIN k1m USING (symbol) GROUP BY s.symbol"""))
def _(spark, d):
    return C.first_available(_listed(spark, d), tb.klines(spark, d, "1m", MINUTE_MS))


@query("range_stats", "A8 W14", with_views("order_ticks", """SELECT symbol, high, low, total_volume, last_close,
    last_close - first_open AS change,
    floor((last_close - first_open) / first_open * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS change_pct,
    (last_close - low) / CASE WHEN high = low THEN 1 ELSE high - low END * 100 AS position_pct,
    last_close - first_open >= 0 AS is_up
    FROM (SELECT symbol, max(price) AS high, min(price) AS low, sum(volume) AS total_volume,
          arg_min(price, (event_time, seq)) AS first_open, arg_max(price, (event_time, seq)) AS last_close
          FROM order_ticks GROUP BY symbol)"""))
def _(spark, d):
    daily = C.candles_from_ticks(tb.order_ticks(spark, d), DAY_MS)
    return C.range_stats(daily)


@query("sparkline", "A9", with_views("c1h", """SELECT symbol, open_time,
    CASE WHEN n > 1 THEN CAST(i - 1 AS DOUBLE) / CAST(n - 1 AS DOUBLE) * 200 END AS x,
    40 - (close - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 40 AS y
    FROM (SELECT symbol, open_time, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i,
          count(*) OVER (PARTITION BY symbol) AS n, min(close) OVER (PARTITION BY symbol) AS lo,
          max(close) OVER (PARTITION BY symbol) AS hi FROM c1h)"""))
def _(spark, d):
    return C.sparkline(tb.candles(spark, d, HOUR_MS), HOUR_MS)


_GAPS = f""", points AS ({_POINTS}), gaps AS (SELECT symbol, time - elapsed_ms + 60000 AS gap_start, time AS gap_end, elapsed_ms
    FROM (SELECT symbol, time, time - lag(time) OVER (PARTITION BY symbol ORDER BY time) AS elapsed_ms FROM points)
    WHERE elapsed_ms > {{min_gap}})"""


@query("price_gaps", "W9", with_views("ticks", _GAPS.format(min_gap=300_000) + " SELECT * FROM gaps"))
def _(spark, d):
    return C.detect_gaps(tb.ticks(spark, d))


@query("gap_totals", "A10", with_views("ticks", _GAPS.format(min_gap=3 * HOUR_MS) +
       " SELECT count(*) AS gaps, count(DISTINCT symbol) AS symbols_with_gaps FROM gaps"))
def _(spark, d):
    return C.gap_totals(C.detect_gaps(tb.ticks(spark, d), 3 * HOUR_MS))


@query("gap_filled_1h", "W10", with_views("c1h", f"""SELECT g.symbol, g.t AS open_time,
    coalesce(open, carried) AS open, coalesce(high, carried) AS high, coalesce(low, carried) AS low, carried AS close,
    coalesce(volume, 0) AS volume, close IS NULL AS is_filled FROM (
      SELECT grid.symbol, t, open, high, low, close, volume,
        last_value(close IGNORE NULLS) OVER (PARTITION BY grid.symbol ORDER BY t) AS carried
      FROM (SELECT symbol, unnest(range(min(open_time), max(open_time) + 1, {HOUR_MS})) AS t FROM c1h GROUP BY symbol) grid
      LEFT JOIN c1h ON c1h.symbol = grid.symbol AND c1h.open_time = t) g"""))
def _(spark, d):
    return C.gap_fill(tb.candles(spark, d, HOUR_MS), HOUR_MS)


_WINDOW_FILL = f""", w AS (SELECT symbol, open_time - open_time % {DAY_MS} AS day, min(open_time) AS first_time
      FROM c1h GROUP BY ALL),
    grid AS (SELECT symbol, day, unnest(range(day, day + {DAY_MS}, {HOUR_MS})) AS t FROM w),
    dense AS (SELECT grid.symbol, day, t, open, high, low, close, volume,
      coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY grid.symbol ORDER BY t),
               first_value(close IGNORE NULLS) OVER (PARTITION BY grid.symbol ORDER BY t
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS carried
      FROM grid LEFT JOIN c1h ON c1h.symbol = grid.symbol AND c1h.open_time = t)"""


@query("filled_day_windows", "W10 A11 T4", with_views("c1h", _WINDOW_FILL + """ SELECT symbol, day AS open_time,
    arg_min(coalesce(open, carried), t) AS open, max(coalesce(high, carried)) AS high,
    min(coalesce(low, carried)) AS low, arg_max(carried, t) AS close, sum(coalesce(volume, 0)) AS volume,
    count(*) FILTER (WHERE volume > 0) AS real_count, count(*) AS step_count FROM dense GROUP BY 1, 2"""))
def _(spark, d):
    return C.roll_up_filled(tb.candles(spark, d, HOUR_MS), HOUR_MS, DAY_MS)


_THROTTLED = """, flagged AS (SELECT seq, symbol, event_time, price,
      row_number() OVER (PARTITION BY symbol ORDER BY event_time, seq) AS i,
      price IS DISTINCT FROM lag(price) OVER (PARTITION BY symbol ORDER BY event_time, seq) AS changed FROM {ticks}),
    walk AS (SELECT seq, symbol, event_time, price, i, true AS sent, event_time AS sent_at, 'change' AS reason
        FROM flagged WHERE i = 1
      UNION ALL SELECT f.seq, f.symbol, f.event_time, f.price, f.i,
        f.changed OR f.event_time - w.sent_at >= {beat},
        CASE WHEN f.changed OR f.event_time - w.sent_at >= {beat} THEN f.event_time ELSE w.sent_at END,
        CASE WHEN f.changed THEN 'change' WHEN f.event_time - w.sent_at >= {beat} THEN 'heartbeat' ELSE 'skipped' END
        FROM walk w JOIN flagged f ON f.symbol = w.symbol AND f.i = w.i + 1)"""
# Ticks with the price cut to a coarse step, so that it repeats; the heartbeat is two hours.
COARSE = "coarse AS (SELECT seq, symbol, event_time, floor(price / 40.0::DOUBLE) AS price FROM ticks)"
BEAT_MS = 2 * HOUR_MS


def coarse_ticks(spark, d) -> DataFrame:
    return tb.ticks(spark, d).withColumn("price", F.floor(F.col("price") / 40.0).cast("double"))


@query("throttled_ticks", "T1 U3", with_views("ticks", f", {COARSE}" + _THROTTLED.format(ticks="coarse", beat=BEAT_MS) +
       " SELECT symbol, seq, event_time, price, reason FROM walk WHERE sent", recursive=True))
def _(spark, d):
    return sent_only(throttle(coarse_ticks(spark, d), BEAT_MS))


@query("ingest_accounting", "A12 W13", with_views("ticks", f", {COARSE}" + _THROTTLED.format(ticks="coarse", beat=BEAT_MS) +
       " SELECT reason, count(*) AS n FROM walk GROUP BY reason", recursive=True))
def _(spark, d):
    return ingest_accounting(throttle(coarse_ticks(spark, d), BEAT_MS))


@query("hourly_table", "A13", with_views("k1m", f"""SELECT symbol, bucket AS open_time,
    arg_min(open, kline_start) AS open, max(high) AS high, min(low) AS low, arg_max(close, kline_start) AS close,
    sum(volume) AS volume FROM (SELECT *, kline_start - kline_start % {HOUR_MS} AS bucket FROM k1m WHERE is_closed)
    GROUP BY symbol, bucket"""))
def _(spark, d):
    from ..plans.jobs import build_hourly
    path = fresh_dir(spark, "hourly")
    minutes = tb.klines(spark, d, "1m", MINUTE_MS)
    # First the older part, then everything since: the second run upserts into the first.
    build_hourly(spark, minutes.filter(F.col("kline_start") < tb.CUTOFF_MS), path)
    build_hourly(spark, minutes, path, since_ms=tb.CUTOFF_MS - DAY_MS - 1)
    return spark.read.parquet(path).drop("dt")


# ------------------------------------------------------------------------------- indicators

def _sma_sql(n: int, digits: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) OVER {frame} = {n} THEN round(avg(close) OVER {frame}, {digits}) END"


@query("sma", "W1", with_views("c1h", f"""SELECT symbol, open_time, {_sma_sql(20, 6)} AS sma20,
    {_sma_sql(50, 6)} AS sma50 FROM c1h"""))
def _(spark, d):
    out = I.sma(tb.candles(spark, d, HOUR_MS), (20, 50), HOUR_MS)
    return out.select("symbol", "open_time", F.round("sma20", 6).alias("sma20"), F.round("sma50", 6).alias("sma50"))


_SERIES = """, series AS (SELECT symbol, open_time, close,
    row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i FROM c1h)"""


@query("ema_first_seed", "W2", with_views("c1h", _SERIES + """, walk AS (
    SELECT symbol, open_time, i, close AS e12, close AS e26 FROM series WHERE i = 1
    UNION ALL SELECT s.symbol, s.open_time, s.i, s.close * (2.0::DOUBLE / 13) + e12 * (1 - 2.0::DOUBLE / 13),
      s.close * (2.0::DOUBLE / 27) + e26 * (1 - 2.0::DOUBLE / 27)
    FROM walk JOIN series s ON s.symbol = walk.symbol AND s.i = walk.i + 1)
    SELECT symbol, open_time, round(e12, 6) AS ema12, round(e26, 6) AS ema26 FROM walk""", recursive=True))
def _(spark, d):
    out = I.ema(tb.candles(spark, d, HOUR_MS), (12, 26), HOUR_MS)
    return out.select("symbol", "open_time", F.round("ema12", 6).alias("ema12"), F.round("ema26", 6).alias("ema26"))


@query("ema_sma_seed", "W3", with_views("c1h", _SERIES + """, walk AS (
    SELECT symbol, 20::BIGINT AS i, avg(close) AS e FROM series WHERE i <= 20 GROUP BY symbol HAVING count(*) = 20
    UNION ALL SELECT s.symbol, s.i, s.close * (2.0::DOUBLE / 21) + e * (1 - 2.0::DOUBLE / 21)
    FROM walk JOIN series s ON s.symbol = walk.symbol AND s.i = walk.i + 1)
    SELECT symbol, open_time, round(e, 6) AS ema20 FROM walk JOIN series USING (symbol, i)""", recursive=True))
def _(spark, d):
    out = I.ema(tb.candles(spark, d, HOUR_MS), (20,), HOUR_MS, seed="sma").filter(F.col("ema20").isNotNull())
    return out.select("symbol", "open_time", F.round("ema20", 6).alias("ema20"))


@query("rsi14", "W4", with_views("c1h", _SERIES + """, moves AS (SELECT symbol, open_time, i - 1 AS i,
      close - lag(close) OVER (PARTITION BY symbol ORDER BY i) AS m FROM series QUALIFY m IS NOT NULL),
    walk AS (SELECT symbol, 14::BIGINT AS i, sum(greatest(m, 0)) / 14 AS g, sum(greatest(-m, 0)) / 14 AS l
      FROM moves WHERE i <= 14 GROUP BY symbol HAVING count(*) = 14
    UNION ALL SELECT s.symbol, s.i, (g * 13 + greatest(s.m, 0)) / 14, (l * 13 + greatest(-s.m, 0)) / 14
    FROM walk JOIN moves s ON s.symbol = walk.symbol AND s.i = walk.i + 1)
    SELECT symbol, open_time, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi
    FROM walk JOIN moves USING (symbol, i)""", recursive=True))
def _(spark, d):
    return I.rsi(tb.candles(spark, d, HOUR_MS), 14, HOUR_MS).select("symbol", "open_time", F.round("rsi", 6).alias("rsi"))


_MFI_FRAME = "(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"


@query("mfi14", "W5", with_views("c1h", f""", typical AS (SELECT symbol, open_time, (high + low + close) / 3 AS tp,
      (high + low + close) / 3 * volume AS flow, lag((high + low + close) / 3) OVER (PARTITION BY symbol ORDER BY open_time) AS p FROM c1h),
    flows AS (SELECT symbol, open_time, count(p) OVER {_MFI_FRAME} AS n,
      sum(CASE WHEN tp >= p THEN flow ELSE 0 END) OVER {_MFI_FRAME} AS i,
      sum(CASE WHEN tp < p THEN flow ELSE 0 END) OVER {_MFI_FRAME} AS o FROM typical)
    SELECT symbol, open_time, round(CASE WHEN o = 0 THEN 100 ELSE 100 - 100 / (1 + i / o) END, 6) AS mfi
    FROM flows WHERE n = 14"""))
def _(spark, d):
    return I.mfi(tb.candles(spark, d, HOUR_MS), 14, HOUR_MS).select("symbol", "open_time", F.round("mfi", 6).alias("mfi"))


INDICATORS = f""", bars AS (SELECT symbol, kline_start AS open_time, close FROM k1h WHERE is_closed),
    series AS (SELECT symbol, open_time, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i FROM bars),
    walk AS (SELECT symbol, open_time, i, close AS e12, close AS e26 FROM series WHERE i = 1
      UNION ALL SELECT s.symbol, s.open_time, s.i, s.close * (2.0::DOUBLE / 13) + e12 * (1 - 2.0::DOUBLE / 13),
        s.close * (2.0::DOUBLE / 27) + e26 * (1 - 2.0::DOUBLE / 27)
      FROM walk JOIN series s ON s.symbol = walk.symbol AND s.i = walk.i + 1),
    averages AS (SELECT symbol, open_time, close, {_sma_sql(20, 6)} AS sma20, {_sma_sql(50, 6)} AS sma50 FROM bars),
    indicators AS (SELECT symbol, open_time AS timestamp, sma20, sma50, round(e12, 6) AS ema12, round(e26, 6) AS ema26,
      close FROM walk JOIN averages USING (symbol, open_time))"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("indicator_rows", "W6 T7", with_views("k1h", INDICATORS + " SELECT * FROM indicators", recursive=True))
def _(spark, d):
    return rounded(I.indicator_rows(tb.klines(spark, d, "1h", HOUR_MS), HOUR_MS), "sma20", "sma50", "ema12", "ema26")


@query("latest_indicators", "W7", with_views("k1h", INDICATORS + """ SELECT symbol, timestamp, sma20, sma50, ema12, ema26
    FROM indicators QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""", recursive=True))
def _(spark, d):
    rows = I.indicator_rows(tb.klines(spark, d, "1h", HOUR_MS), HOUR_MS)
    latest = latest_per_symbol(rows.drop("close").withColumn("_at", F.col("timestamp")), "_at").drop("_at")
    return rounded(latest, "sma20", "sma50", "ema12", "ema26")


_SIDE = "CASE WHEN p IS NULL OR price >= p THEN 'buy' ELSE 'sell' END AS side"


@query("trade_sides", "W8", with_views("ticks", f"""SELECT seq, symbol, event_time, price, volume, {_SIDE}
    FROM (SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY event_time, seq) AS p FROM ticks)"""))
def _(spark, d):
    return trade_sides(tb.ticks(spark, d))


@query("trade_sides_tick_rule", "W8", with_views("ticks", f"""SELECT seq, symbol, event_time, price, volume, {_SIDE}
    FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY event_time, seq) AS p FROM ticks)"""))
def _(spark, d):
    return trade_sides(tb.ticks(spark, d), rule="tick")


@query("bar_positions", "W14", with_views("c1h", """SELECT symbol, open_time,
    row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS row_index,
    count(*) OVER (PARTITION BY symbol) AS row_count FROM c1h"""))
def _(spark, d):
    rows = tb.candles(spark, d, HOUR_MS).select("symbol", "open_time")
    return with_row_index(rows, HOUR_MS * BLOCK_STEPS, ["open_time"])


@query("as_of_close", "J9", with_views("c1h ticks", """SELECT t.seq, t.symbol, c.close FROM ticks t ASOF LEFT JOIN
    (SELECT symbol, open_time + 3600000 AS known_at, close FROM c1h) c ON t.symbol = c.symbol AND t.event_time >= c.known_at"""))
def _(spark, d):
    probes = tb.ticks(spark, d).select("symbol", "event_time", "seq")
    closes = tb.candles(spark, d, HOUR_MS).select(
        "symbol", (F.col("open_time") + HOUR_MS).alias("event_time"), "close")
    return C.as_of(probes, closes, "close", DAY_MS, "event_time").select("seq", "symbol", "close")


FIELDS = ("open", "high", "low", "close", "volume")


@query("field_rows", "X2", with_views("c1h", "SELECT symbol, open_time AS time, field, value FROM (UNPIVOT (SELECT symbol, "
       "open_time, open, high, low, close, volume FROM c1h) ON open, high, low, close, volume INTO NAME field VALUE value)"))
def _(spark, d):
    wide = tb.candles(spark, d, HOUR_MS).withColumnRenamed("open_time", "time")
    return R.unpivot_fields(wide, FIELDS)


@query("wide_records", "X1", with_views("c1h", "SELECT symbol, open_time AS time, open, high, low, close, volume FROM c1h"))
def _(spark, d):
    wide = tb.candles(spark, d, HOUR_MS).withColumnRenamed("open_time", "time")
    return R.pivot_fields(R.unpivot_fields(wide, FIELDS), FIELDS)


@query("bounded_history", "K12", with_views("c1h", f"""SELECT {OHLCV} FROM c1h
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 60"""))
def _(spark, d):
    return newest_n(tb.candles(spark, d, HOUR_MS), 60)
