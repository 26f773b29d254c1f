"""Merges, dedup, lookups, order books and served queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import book as B, candles as C, lookup as L, merge as M
from ..plans import paging, serving as P
from ..schemas import DAY_MS, HOUR_MS, INTERVAL_MS, MINUTE_MS
from ..session import fresh_dir
from ..sources import lake, tables as tb
from .bars import _GAPS, _POINTS
from .ingest import all_klines
from .registry import OHLCV, query, with_views

CUT, NOW = tb.CUTOFF_MS, tb.NOW_MS
FOUR_H = 4 * HOUR_MS


def hourly(spark, d) -> DataFrame:
    return tb.candles(spark, d, HOUR_MS)


# ------------------------------------------------------------------- dedup, merge and upsert

@query("priority_merge", "D1 J8", with_views("hot cold", f"""SELECT {OHLCV} FROM hot
    UNION ALL SELECT {OHLCV} FROM cold ANTI JOIN hot USING (symbol, open_time)"""))
def _(spark, d):
    return M.priority_merge(tb.cold(spark, d, HOUR_MS), tb.hot(spark, d, HOUR_MS))


@query("priority_merge_cold_wins", "D1", with_views("hot cold", f"""SELECT {OHLCV} FROM cold
    UNION ALL SELECT {OHLCV} FROM hot ANTI JOIN cold USING (symbol, open_time)"""))
def _(spark, d):
    return M.priority_merge(tb.hot(spark, d, HOUR_MS), tb.cold(spark, d, HOUR_MS))


def ticks_as_candles(spark, d, step: int) -> DataFrame:
    """Every tick as a flat candle at the start of its step: many rows per step."""
    t = tb.ticks(spark, d)
    return t.select("symbol", (F.col("event_time") - F.col("event_time") % step).alias("open_time"),
                    *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "volume", "seq")


_FLAT = """flat AS (SELECT symbol, event_time - event_time % {step} AS open_time, price AS open, price AS high,
    price AS low, price AS close, volume, seq FROM ticks)"""
FLAT_HOUR = _FLAT.format(step=HOUR_MS)


@query("best_volume_per_step", "D2", with_views("ticks", f""", {FLAT_HOUR} SELECT {OHLCV} FROM flat
    QUALIFY row_number() OVER (PARTITION BY symbol, open_time ORDER BY volume DESC, seq) = 1"""))
def _(spark, d):
    return M.best_by_volume(ticks_as_candles(spark, d, HOUR_MS))


@query("upserted_candles", "D3", with_views("ticks hot", f""", {FLAT_HOUR}, incoming AS (SELECT {OHLCV} FROM flat
    QUALIFY row_number() OVER (PARTITION BY symbol, open_time ORDER BY seq DESC) = 1)
    SELECT {OHLCV} FROM incoming UNION ALL SELECT {OHLCV} FROM hot ANTI JOIN incoming USING (symbol, open_time)"""))
def _(spark, d):
    return M.upsert(tb.hot(spark, d, HOUR_MS), ticks_as_candles(spark, d, HOUR_MS))


HISTORY = """history AS (SELECT symbol, price, volume, arg_max(event_time, ticks.seq) AS event_time, max(ticks.seq) AS seq
    FROM ticks GROUP BY symbol, price, volume)"""


@query("price_volume_history", "D4", with_views("ticks", f", {HISTORY} SELECT * FROM history"))
def _(spark, d):
    return M.dedup_price_volume(tb.ticks(spark, d))


@query("latest_tickers", "D5 T10", with_views("latest", "SELECT * FROM latest"))
def _(spark, d):
    return tb.latest_tickers(spark, d)


@query("latest_klines", "D5", with_views("k1h", """SELECT symbol, kline_start, "interval", open, high, low, close,
    volume, is_closed FROM k1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY kline_start DESC) = 1"""))
def _(spark, d):
    rows = tb.klines(spark, d, "1h", HOUR_MS).select("symbol", "kline_start", "interval", "open", "high", "low",
                                                     "close", "volume", "is_closed")
    return M.latest_per_symbol(rows.withColumn("_at", F.col("kline_start")), "_at").drop("_at")


_TWICE = "(SELECT * FROM tickers UNION ALL SELECT * REPLACE (seq + 1000000000000 AS seq, close + 1 AS close) FROM tickers WHERE h24_volume < 50)"


@query("deduplicated_tickers", "D6", with_views("tickers", f"""SELECT symbol, event_time, close FROM {_TWICE}
    QUALIFY row_number() OVER (PARTITION BY symbol, event_time ORDER BY seq DESC) = 1"""))
def _(spark, d):
    once = tb.tickers(spark, d)
    again = once.filter("h24_volume < 50").withColumn("seq", F.col("seq") + 1_000_000_000_000).withColumn("close", F.col("close") + 1)
    return M.dedup_tickers(once.unionByName(again)).select("symbol", "event_time", "close")


@query("deduplicated_klines", "D7", with_views("k1m", """SELECT symbol, kline_start,
    CASE WHEN volume < 50 THEN close + 1 ELSE close END AS close FROM k1m WHERE is_closed"""))
def _(spark, d):
    from ..operators.normalize import closed_minutes
    once = closed_minutes(tb.klines(spark, d, "1m", MINUTE_MS)).select("symbol", "kline_start", "close", "volume", F.lit(0).alias("seq"))
    again = once.filter("volume < 50").withColumn("seq", F.lit(1)).withColumn("close", F.col("close") + 1)
    return M.dedup_klines(once.unionByName(again)).select("symbol", "kline_start", "close")


@query("scroll_prepend", "D9", with_views("hot cold", f"""SELECT {OHLCV} FROM hot UNION ALL
    SELECT {OHLCV} FROM cold JOIN (SELECT symbol, min(open_time) AS first FROM hot GROUP BY symbol) USING (symbol)
    WHERE open_time < first"""))
def _(spark, d):
    return M.prepend_older(tb.hot(spark, d, HOUR_MS), tb.cold(spark, d, HOUR_MS))


_POLLED = f"SELECT symbol, open_time, open, high, low, close, CASE WHEN volume < 100 THEN volume + 5 ELSE volume END AS volume FROM c1h WHERE open_time >= {CUT - 2 * DAY_MS}"


@query("incremental_poll", "D10", with_views("cold c1h", f""", polled AS ({_POLLED}), newest AS (SELECT symbol, max(open_time) AS last FROM cold GROUP BY symbol)
    SELECT symbol, open_time, CASE WHEN ch THEN p_open ELSE open END AS open, CASE WHEN ch THEN p_high ELSE high END AS high,
      CASE WHEN ch THEN p_low ELSE low END AS low, CASE WHEN ch THEN p_close ELSE close END AS close,
      CASE WHEN ch THEN p_volume ELSE volume END AS volume FROM (
      SELECT c.*, p.open AS p_open, p.high AS p_high, p.low AS p_low, p.close AS p_close, p.volume AS p_volume,
        coalesce(p.volume <> c.volume AND c.open_time < last, false) AS ch
      FROM cold c JOIN newest USING (symbol) LEFT JOIN polled p ON p.symbol = c.symbol AND p.open_time = c.open_time)
    UNION ALL SELECT {OHLCV} FROM polled JOIN newest USING (symbol) WHERE open_time > last"""))
def _(spark, d):
    polled = hourly(spark, d).filter(F.col("open_time") >= CUT - 2 * DAY_MS).withColumn(
        "volume", F.when(F.col("volume") < 100, F.col("volume") + 5).otherwise(F.col("volume")))
    return M.poll_merge(tb.cold(spark, d, HOUR_MS), polled, "1h")


def _live(spark, d, step) -> DataFrame:
    """One pushed candle per symbol, placed before, at or after the newest cold one."""
    t = tb.latest_tickers(spark, d)
    at = (F.when(F.col("volume") < 30, CUT - 5 * step).when(F.col("volume") < 60, CUT - CUT % step - step)
          .otherwise(CUT - CUT % step + step))
    return t.select("symbol", at.cast("bigint").alias("open_time"),
                    *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))


_LIVE = f"""live AS (SELECT symbol, CASE WHEN volume < 30 THEN {CUT - 5 * HOUR_MS} WHEN volume < 60 THEN {CUT - CUT % HOUR_MS - HOUR_MS}
    ELSE {CUT - CUT % HOUR_MS + HOUR_MS} END AS open_time, price AS open, price AS high, price AS low, price AS close, 1.0::DOUBLE AS volume FROM latest),
    accepted AS (SELECT live.* FROM live JOIN (SELECT symbol, max(open_time) AS last FROM cold GROUP BY symbol) USING (symbol) WHERE open_time {{op}} last)"""


@query("live_update_1h", "D11", with_views("cold latest", f""", {_LIVE.format(op='>=')} SELECT {OHLCV} FROM accepted
    UNION ALL SELECT {OHLCV} FROM cold ANTI JOIN accepted USING (symbol, open_time)"""))
def _(spark, d):
    return M.apply_live(tb.cold(spark, d, HOUR_MS), _live(spark, d, HOUR_MS), "1h")


@query("live_update_1s", "D11 K12", with_views("cold latest", f""", {_LIVE.format(op='>')} SELECT {OHLCV} FROM (
    SELECT {OHLCV} FROM accepted UNION ALL SELECT {OHLCV} FROM cold)"""))
def _(spark, d):
    return M.apply_live(tb.cold(spark, d, HOUR_MS), _live(spark, d, HOUR_MS), "1s")


@query("changed_candles", "D12 T12", with_views("ticks", """SELECT symbol, seq, level FROM (
    SELECT symbol, seq, floor(price / 40.0::DOUBLE) AS level, row_number() OVER w AS i, lag(floor(price / 40.0::DOUBLE)) OVER w AS p FROM ticks
    WINDOW w AS (PARTITION BY symbol ORDER BY seq)) WHERE i = 1 OR level IS DISTINCT FROM p"""))
def _(spark, d):
    rows = tb.ticks(spark, d).select("symbol", "seq", F.floor(F.col("price") / 40.0).cast("double").alias("level"))
    return M.change_only(rows, "seq", block_ms=1000)


@query("metadata_override", "D13", """SELECT CAST(c_custkey AS VARCHAR) AS base,
    CASE WHEN c_acctbal > 0 THEN c_name || ' (' || c_mktsegment || ')' ELSE c_name END AS name FROM customer
    WHERE c_custkey % 3 <> 0 OR c_acctbal > 0""")
def _(spark, d):
    # Names known before, and fresher ones for a part of the assets, some of them new.
    named = tb.load(spark, d, "customer").withColumn("base", F.col("c_custkey").cast("string"))
    fallback = named.filter("c_custkey % 3 <> 0").select("base", F.col("c_name").alias("name"))
    fresh = named.filter("c_acctbal > 0").select("base", F.format_string("%s (%s)", "c_name", "c_mktsegment").alias("name"))
    return M.override_metadata(fallback, fresh)


@query("idempotent_append", "D14", with_views("hot cold", f"SELECT {OHLCV} FROM hot ANTI JOIN cold USING (symbol, open_time)"))
def _(spark, d):
    twice = tb.hot(spark, d, HOUR_MS).unionByName(tb.hot(spark, d, HOUR_MS))
    return M.only_new(twice, tb.cold(spark, d, HOUR_MS), ["symbol", "open_time"])


# ----------------------------------------------------------------------- joins and lookups

def _enriched_sql(source: str, step: int, now: int) -> str:
    return f"""newest AS (SELECT symbol, max(open_time) AS last FROM {source} GROUP BY symbol),
    live AS (SELECT latest.*, event_time - event_time % {step} AS bucket, last FROM latest LEFT JOIN newest USING (symbol)),
    enriched AS (SELECT c.symbol, open_time, open, CASE WHEN hit THEN greatest(high, price) ELSE high END AS high,
        CASE WHEN hit THEN least(low, price) ELSE low END AS low, CASE WHEN hit THEN price ELSE close END AS close, volume
      FROM (SELECT c.*, price, coalesce(c.open_time = bucket AND bucket = last AND event_time > last AND {now} < bucket + {step}, false) AS hit
            FROM (SELECT {OHLCV} FROM {source}) c LEFT JOIN (SELECT symbol, bucket, last, event_time, price FROM live) l ON l.symbol = c.symbol) c
      UNION ALL SELECT symbol, bucket, price, price, price, price, 0 FROM live WHERE last IS NULL OR bucket > last)"""


@query("live_enriched_open", "J1", with_views("c1h latest", f", bars AS (SELECT {OHLCV} FROM c1h), " + _enriched_sql("bars", HOUR_MS, 0)
       + f" SELECT {OHLCV} FROM enriched"))
def _(spark, d):
    # With "now" before every window end, the newest bar of each symbol is still open.
    return L.enrich_with_live(hourly(spark, d), tb.latest_tickers(spark, d), HOUR_MS, now_ms=0)


@query("live_enriched_behind", "J1", with_views("cold latest", ", " + _enriched_sql("cold", HOUR_MS, NOW)
       + f" SELECT {OHLCV} FROM enriched"))
def _(spark, d):
    return L.enrich_with_live(tb.cold(spark, d, HOUR_MS), tb.latest_tickers(spark, d), HOUR_MS, NOW)


_SOURCE = f"source AS (SELECT symbol, open_time, open, high, low, close, volume FROM c1m WHERE symbol <> 'VIEWUSDT' AND open_time < {NOW} + CASE WHEN symbol = 'ERRORUSDT' THEN -20 ELSE 2 END * {DAY_MS})"


@query("pushed_bars", "J2", with_views("c1m latest k1h symbols", f""", {_SOURCE},
    bars AS (SELECT symbol, bucket AS open_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low,
      arg_max(close, open_time) AS close, sum(volume) AS volume, max(open_time) AS newest FROM (
        SELECT *, open_time - open_time % {FOUR_H} AS bucket, max(open_time) OVER (PARTITION BY symbol) AS m FROM source)
      WHERE bucket = m - m % {FOUR_H} GROUP BY symbol, bucket),
    stored AS (SELECT symbol, kline_start - kline_start % {FOUR_H} AS s_time, open AS s_open, high AS s_high, low AS s_low, close AS s_close,
      volume AS s_volume FROM k1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY kline_start DESC) = 1),
    tick AS (SELECT symbol, price, event_time, event_time - event_time % {FOUR_H} AS b FROM latest WHERE symbol <> 'CLICKUSDT'),
    joined AS (SELECT s.symbol, bars.* EXCLUDE (symbol), stored.* EXCLUDE (symbol), price, b,
      coalesce(b = bars.open_time AND event_time > newest AND 0 < bars.open_time, false) AS fresh,
      coalesce(b > coalesce(bars.open_time, 0), false) AS ahead
      FROM symbols s LEFT JOIN bars ON bars.symbol = s.symbol LEFT JOIN stored ON stored.symbol = s.symbol LEFT JOIN tick ON tick.symbol = s.symbol)
    SELECT symbol, CASE WHEN ahead THEN b ELSE coalesce(open_time, s_time) END AS open_time,
      CASE WHEN ahead THEN price ELSE coalesce(open, s_open) END AS open,
      CASE WHEN ahead THEN price WHEN fresh THEN greatest(high, price) ELSE coalesce(high, s_high) END AS high,
      CASE WHEN ahead THEN price WHEN fresh THEN least(low, price) ELSE coalesce(low, s_low) END AS low,
      CASE WHEN ahead OR fresh THEN price ELSE coalesce(close, s_close) END AS close,
      CASE WHEN ahead THEN 0 ELSE coalesce(volume, s_volume) END AS volume FROM joined"""))
def _(spark, d):
    # One symbol has no source candles, one has only old ones, one has no ticker.
    until = F.when(F.col("symbol") == "ERRORUSDT", NOW - 20 * DAY_MS).otherwise(NOW + 2 * DAY_MS)
    source = tb.candles(spark, d, MINUTE_MS).filter((F.col("symbol") != "VIEWUSDT") & (F.col("open_time") < until))
    stored = M.latest_per_symbol(tb.klines(spark, d, "1h", HOUR_MS).withColumn("_at", F.col("kline_start")), "_at")
    tickers = tb.latest_tickers(spark, d).filter("symbol <> 'CLICKUSDT'")
    return L.pushed_bar(source, tickers, stored, tb.symbols(spark, d), FOUR_H, now_ms=0)


@query("watchlist", "J3", with_views("symbols latest", """SELECT symbol, coalesce(l.price, 1.5) AS price, coalesce(l.change24h, 0.25) AS change,
    CASE WHEN l.price IS NULL THEN 'gray' WHEN l.price > 0 THEN CASE WHEN l.change24h >= 0 THEN 'green' ELSE 'red' END ELSE 'gray' END AS color
    FROM symbols LEFT JOIN (SELECT * FROM latest WHERE symbol <> 'VIEWUSDT') l USING (symbol)"""))
def _(spark, d):
    items = tb.symbols(spark, d).select("symbol", F.lit(1.5).alias("price"), F.lit(0.25).alias("change"), F.lit("gray").alias("color"))
    return L.refresh_watchlist(items, tb.latest_tickers(spark, d).filter("symbol <> 'VIEWUSDT'"))


@query("symbol_metadata", "J4", with_views("ticks meta_old", """SELECT seq, symbol, base, name FROM
    (SELECT seq, symbol, replace(symbol, 'USDT', '') AS base FROM ticks) LEFT JOIN meta_old USING (base)"""))
def _(spark, d):
    fallback, _fresh = tb.symbol_metadata(spark)
    return L.with_metadata(tb.ticks(spark, d).select("seq", "symbol"), fallback)


@query("starred_items", "J5", with_views("ticks latest", """SELECT seq, symbol, price FROM ticks
    SEMI JOIN (SELECT symbol FROM latest WHERE change24h < 0) USING (symbol)"""))
def _(spark, d):
    stars = tb.latest_tickers(spark, d).filter(F.col("change24h") < 0)
    return L.starred(tb.ticks(spark, d).select("seq", "symbol", "price"), stars)


def _round8(x: str) -> str:
    return f"floor(({x}) * 100000000.0::DOUBLE + 0.5::DOUBLE) / 100000000.0::DOUBLE"


LATEST_BOOK = """newest_book AS (SELECT * FROM books QUALIFY row_number() OVER
    (PARTITION BY symbol ORDER BY event_time DESC, last_update_id DESC) = 1)"""


@query("book_or_ticker", "J6 B4", with_views("books latest", f""", {LATEST_BOOK}, quotes AS (
      SELECT 'S' || (row_number() OVER (ORDER BY symbol) * 7) AS symbol, bid, ask, event_time FROM latest
      UNION ALL SELECT symbol, CASE WHEN volume < 30 THEN 0 ELSE bid END, ask, event_time FROM latest),
    wanted AS (SELECT symbol FROM newest_book UNION SELECT symbol FROM quotes)
    SELECT symbol, CASE WHEN b.symbol IS NULL THEN q.event_time ELSE b.event_time END AS event_time,
      CASE WHEN b.symbol IS NULL THEN q.bid ELSE coalesce(bid1, 0) END AS best_bid,
      CASE WHEN b.symbol IS NULL THEN q.ask ELSE coalesce(ask1, 0) END AS best_ask,
      CASE WHEN b.symbol IS NULL THEN {_round8('q.ask - q.bid')} WHEN bid_depth > 0 AND ask_depth > 0 THEN {_round8('ask1 - bid1')} ELSE 0 END AS spread,
      CASE WHEN b.symbol IS NULL THEN 1 ELSE bid_depth END AS bids, CASE WHEN b.symbol IS NULL THEN 1 ELSE ask_depth END AS asks,
      b.symbol IS NULL AS is_synthetic
    FROM wanted LEFT JOIN newest_book b USING (symbol) LEFT JOIN quotes q USING (symbol) WHERE b.symbol IS NOT NULL OR (q.bid > 0 AND q.ask > 0)""".replace(
    "SELECT symbol, CASE WHEN b.symbol", "SELECT wanted.symbol, CASE WHEN b.symbol")))
def _(spark, d):
    newest = B.latest_book(tb.books(spark, d))
    latest = tb.latest_tickers(spark, d)
    # Ticker names S7, S14, ... also have books; the plain ones do not, and some lack a bid.
    renamed = {"CLICKUSDT": "S7", "ERRORUSDT": "S14", "PURCHASEUSDT": "S21", "SIGNUPUSDT": "S28", "VIEWUSDT": "S35"}
    both = latest.select("symbol", "bid", "ask", "event_time").replace(renamed, subset=["symbol"]).unionByName(
        latest.select("symbol", F.when(F.col("volume") < 30, 0.0).otherwise(F.col("bid")).alias("bid"), "ask", "event_time"))
    wanted = newest.select("symbol").unionByName(both.select("symbol")).distinct()
    out = B.book_or_synthetic(wanted, newest, both)
    return out.select("symbol", "event_time", "best_bid", "best_ask", "spread", F.size("bids").cast("bigint").alias("bids"),
                      F.size("asks").cast("bigint").alias("asks"), "is_synthetic")


@query("gap_history_rows", "J7", with_views("ticks k1m", _GAPS.format(min_gap=2 * HOUR_MS) + """ SELECT symbol, gap_start, gap_end, kline_start, close
    FROM gaps JOIN k1m USING (symbol) WHERE kline_start BETWEEN gap_start AND gap_end"""))
def _(spark, d):
    gaps = C.detect_gaps(tb.ticks(spark, d), 2 * HOUR_MS).drop("elapsed_ms")
    rows = tb.klines(spark, d, "1m", MINUTE_MS).select("symbol", "kline_start", "close")
    return L.rows_in_ranges(gaps, rows, "gap_start", "gap_end", "kline_start")


@query("tiered_lookup", "J8", with_views("hot cold c1h", f""", day AS (SELECT symbol, bucket AS open_time, arg_min(open, open_time) AS open,
      max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume FROM
      (SELECT *, open_time - open_time % {DAY_MS} AS bucket FROM c1h) GROUP BY symbol, bucket)
    SELECT {OHLCV} FROM hot UNION ALL SELECT {OHLCV} FROM cold ANTI JOIN hot USING (symbol, open_time)
    UNION ALL SELECT {OHLCV} FROM day ANTI JOIN hot USING (symbol, open_time) ANTI JOIN cold USING (symbol, open_time)"""))
def _(spark, d):
    daily = C.resample(hourly(spark, d), DAY_MS)
    return P.tiered_lookup(tb.hot(spark, d, HOUR_MS), tb.cold(spark, d, HOUR_MS), daily)


# ----------------------------------------------------------------------------- order books

@query("book_features", "B2 B5", with_views("books", f""", {LATEST_BOOK} SELECT symbol, event_time, last_update_id, bid_depth, ask_depth,
    coalesce(bid1, 0) AS best_bid, coalesce(ask1, 0) AS best_ask,
    CASE WHEN bid_depth > 0 AND ask_depth > 0 THEN {_round8('ask1 - bid1')} ELSE 0 END AS spread FROM newest_book"""))
def _(spark, d):
    features = B.level_features(tb.book_levels(spark, d)).drop("spread_pct")
    return M.latest_per_symbol(features.withColumn("_at", F.col("event_time")), "_at").drop("_at")


@query("all_book_features", "B2 B3", with_views("books", f"""SELECT symbol, event_time, bid_depth, ask_depth,
    CASE WHEN bid_depth > 0 AND ask_depth > 0 THEN {_round8('ask1 - bid1')} ELSE 0 END AS spread,
    CASE WHEN bid_depth > 0 AND ask_depth > 0 THEN floor((ask1 - bid1) / ask1 * 100 * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE 0 END AS spread_pct
    FROM books"""))
def _(spark, d):
    return B.level_features(tb.book_levels(spark, d)).select("symbol", "event_time", "bid_depth", "ask_depth", "spread", "spread_pct")


@query("latest_books", "B5", with_views("books levels", f""", {LATEST_BOOK} SELECT l.symbol, event_time, last_update_id,
    CASE WHEN status = 'O' THEN 'bid' ELSE 'ask' END AS side, level, price, qty
    FROM levels l JOIN newest_book USING (symbol, event_time)"""))
def _(spark, d):
    return B.level_rows(B.latest_book(tb.books(spark, d)))


@query("depth_curve", "W11 W12", with_views("levels", """SELECT symbol, event_time, CASE WHEN status = 'O' THEN 'bid' ELSE 'ask' END AS side, level,
    price, qty AS amount, sum(qty) OVER (PARTITION BY symbol, event_time, status ORDER BY level) AS total,
    sum(qty) OVER (PARTITION BY symbol, event_time, status ORDER BY level) / sum(qty) OVER (PARTITION BY symbol, event_time, status) * 100 AS depth_pct
    FROM levels"""))
def _(spark, d):
    return B.depth_curve(tb.book_levels(spark, d))


# -------------------------------------------------------------------------- served queries

def _newest(n: int, source: str, order: str = "open_time") -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY {order} DESC) <= {n}"


def _bars(source: str, step: int) -> str:
    return f"""bars AS (SELECT symbol, bucket AS open_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low,
      arg_max(close, open_time) AS close, sum(volume) AS volume FROM
      (SELECT *, open_time - open_time % {step} AS bucket FROM {source}) GROUP BY symbol, bucket)"""


@query("last_before_cursor", "K1", with_views("c1h", f"""SELECT {OHLCV} FROM c1h WHERE open_time < {CUT}
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 50"""))
def _(spark, d):
    return P.last_before(tb.candles(spark, d, HOUR_MS, until_ms=CUT), 50, CUT)


@query("last_in_range", "K2", with_views("k1m", f"""SELECT {OHLCV.replace('open_time', 'kline_start AS open_time')} FROM k1m
    WHERE is_closed AND kline_start >= {CUT} AND kline_start < {CUT + 5 * DAY_MS}
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY kline_start DESC) <= 300"""))
def _(spark, d):
    return P.last_before(P.stored_minutes(tb.klines(spark, d, "1m", MINUTE_MS, CUT, CUT + 5 * DAY_MS)), 300, CUT + 5 * DAY_MS, CUT)


@query("tagged_range_tail", "K3", with_views("k1s k1m k1h", f"""SELECT {OHLCV.replace('open_time', 'kline_start AS open_time')}
    FROM (SELECT * FROM k1s UNION ALL SELECT * FROM k1m UNION ALL SELECT * FROM k1h)
    WHERE "interval" = '1m' AND is_closed AND kline_start >= {CUT} AND kline_start < {NOW}
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY kline_start DESC) <= 100"""))
def _(spark, d):
    return P.last_before(P.stored_minutes(all_klines(spark, d, CUT, NOW)), 100, NOW, CUT)


@query("look_back_window", "K4", with_views("c1m", f"SELECT {OHLCV} FROM c1m WHERE open_time >= {NOW - 48 * HOUR_MS}"))
def _(spark, d):
    return P.look_back(tb.candles(spark, d, MINUTE_MS, NOW - 48 * HOUR_MS), 48, NOW)


BASE = f"""base AS (SELECT {OHLCV} FROM hot1m WHERE open_time >= {CUT} UNION ALL SELECT {OHLCV} FROM cold1m WHERE open_time < {CUT})"""
# The minutes of the scroll case: every third hour has none, so its bar comes from the hourly table.
_HOLES = f"(open_time // {HOUR_MS}) % 3 <> 0"


@query("base_minutes", "K5", with_views("hot1m cold1m", f""", {BASE}, part AS (SELECT * FROM base WHERE open_time < {NOW}),
    {_bars('part', FOUR_H)} {_newest(60, 'bars')}"""))
def _(spark, d):
    rows = P.base_minutes(tb.hot(spark, d, MINUTE_MS), tb.cold(spark, d, MINUTE_MS), FOUR_H, 60, NOW, CUT)
    return M.newest_n(C.resample(rows, FOUR_H), 60)


_DORMANT = f"(symbol <> 'VIEWUSDT' OR open_time < {CUT - 5 * DAY_MS})"


@query("paged_klines_4h", "K5", with_views("hot1m cold1m", f""", {BASE}, part AS (SELECT * FROM base WHERE open_time < {NOW} AND {_DORMANT}),
    {_bars('part', FOUR_H)} {_newest(12, 'bars')}"""))
def _(spark, d):
    # Day-partitioned tiers; one symbol fell silent before the cutoff, so only its rows are looked for in older pages.
    paths = []
    for name, tier in (("hot", tb.hot), ("cold", tb.cold)):
        paths.append(fresh_dir(spark, f"paged-{name}"))
        lake.append_sorted(tier(spark, d, MINUTE_MS).filter(_DORMANT), paths[-1], "open_time", ("symbol", "open_time"))
    hot, cold = (spark.read.parquet(p) for p in paths)
    first = min(lake.table_days(spark, p)[0] for p in paths)
    rows = paging.paged_minutes(paging.tiered_reader(hot, cold, CUT), tb.symbols(spark, d), FOUR_H, 12, NOW, first)
    return M.newest_n(C.resample(rows.drop("dt"), FOUR_H), 12)


_SECONDS = _FLAT.format(step=1000)


@query("recent_seconds", "K6", with_views("ticks", f""", {_SECONDS}, s AS (SELECT * FROM flat WHERE symbol <> 'VIEWUSDT' OR open_time < {NOW - DAY_MS}),
    fresh AS (SELECT * FROM s WHERE open_time >= {NOW - 3602 * 1000}),
    stale AS (SELECT * FROM s ANTI JOIN fresh USING (symbol)),
    best AS (SELECT * FROM (SELECT * FROM fresh UNION ALL SELECT * FROM stale) QUALIFY row_number() OVER (PARTITION BY symbol, open_time ORDER BY volume DESC, seq) = 1)
    SELECT {OHLCV} FROM best QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 3600"""))
def _(spark, d):
    # One symbol is silent for the last day and falls back to its newest rows.
    rows = ticks_as_candles(spark, d, 1000).filter((F.col("symbol") != "VIEWUSDT") | (F.col("open_time") < NOW - DAY_MS))
    return P.recent_seconds(rows, 3600, NOW)


@query("recent_trades", "K7 W8", with_views("ticks", f""", {HISTORY}, newest AS ({_newest(50, 'history', 'event_time')})
    SELECT symbol, event_time AS time, price, volume, CASE WHEN p IS NULL OR price >= p THEN 'buy' ELSE 'sell' END AS side
    FROM (SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY event_time) AS p FROM newest)"""))
def _(spark, d):
    return L.recent_trades(tb.ticks(spark, d), 50)


@query("recent_klines_4h", "K8", with_views("hot1m latest", f""", live1m AS (SELECT * FROM hot1m WHERE open_time >= {NOW - 90 * DAY_MS}),
    {_bars('live1m', FOUR_H)}, {_enriched_sql('bars', FOUR_H, NOW)} SELECT {OHLCV} FROM ({_newest(40, 'enriched')})"""))
def _(spark, d):
    return P.recent_klines(" 4H ", 40, NOW, tb.hot(spark, d, MINUTE_MS), tickers=tb.latest_tickers(spark, d))


@query("scroll_klines_1h", "K8 K5 J8", with_views("hot1m cold1m c1h", f""", {BASE}, rows AS (SELECT * FROM base WHERE open_time < {NOW} AND {_HOLES}),
    hours AS (SELECT DISTINCT symbol, open_time - open_time % {HOUR_MS} AS open_time FROM rows),
    merged AS (SELECT {OHLCV} FROM rows UNION ALL
      SELECT symbol, open_time, open, high, low, close, volume + 7 FROM c1h ANTI JOIN hours USING (symbol, open_time) WHERE open_time < {NOW}),
    {_bars('merged', HOUR_MS)} {_newest(1500, 'bars')}"""))
def _(spark, d):
    hot, cold = (tier(spark, d, MINUTE_MS).filter(f"(open_time div {HOUR_MS}) % 3 <> 0") for tier in (tb.hot, tb.cold))
    return P.recent_klines("1h", 1500, NOW, hot, cold=cold, end_ms=NOW, retention_ms=NOW - CUT,
                           hourly=hourly(spark, d).withColumn("volume", F.col("volume") + 7))


@query("historical_klines_1d", "K9 J8", with_views("hot1m cold1m c1h", f""", {BASE}, part AS (SELECT * FROM base
      WHERE symbol <> 'VIEWUSDT' AND open_time >= {CUT - 10 * DAY_MS} AND open_time < {NOW}
      UNION ALL SELECT {OHLCV} FROM c1h WHERE symbol = 'VIEWUSDT' AND open_time >= {CUT - 10 * DAY_MS} AND open_time < {NOW}),
    {_bars('part', DAY_MS)} SELECT {OHLCV} FROM bars WHERE open_time >= {CUT - 10 * DAY_MS} AND open_time < {NOW}
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 20"""))
def _(spark, d):
    # One symbol exists only in the hourly table.
    span = CUT - 10 * DAY_MS, NOW
    minutes = [tier(spark, d, MINUTE_MS, *span).filter("symbol <> 'VIEWUSDT'") for tier in (tb.hot, tb.cold)]
    return P.historical_klines("1d", *span, 20, NOW, *minutes, hourly=tb.candles(spark, d, HOUR_MS, *span), retention_ms=NOW - CUT)


@query("all_tickers", "K10", with_views("latest", "SELECT * FROM latest"))
def _(spark, d):
    return P.all_tickers(tb.latest_tickers(spark, d))


@query("watchlist_page", "K11", with_views("ticks_many", """SELECT symbol, n FROM (SELECT symbol, count(*) AS n FROM ticks_many GROUP BY symbol)
    QUALIFY row_number() OVER (ORDER BY symbol) > (count(*) OVER () - 1) // 10 * 10"""))
def _(spark, d):
    counts = tb.ticks_many(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return paging.page(counts, ["symbol"], 9_999)


@query("preloaded_series", "K13", with_views("c1h", f""", cur AS (SELECT {OHLCV} FROM c1h WHERE open_time >= {NOW}),
    have AS (SELECT symbol, count(*) AS n, min(open_time) AS first FROM cur GROUP BY symbol),
    older AS (SELECT {OHLCV} FROM c1h JOIN have USING (symbol) WHERE n < 50 AND open_time < first
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= greatest(50 - n + 20, 50))
    SELECT * FROM cur UNION ALL SELECT * FROM older"""))
def _(spark, d):
    return P.extend_to(hourly(spark, d).filter(F.col("open_time") >= NOW), hourly(spark, d), 50)


@query("user_last_candles", "K1", with_views("ticks_many", f""", u AS (SELECT symbol, event_time - event_time % {DAY_MS} AS open_time,
    arg_max(price, seq) AS close FROM ticks_many GROUP BY 1, 2) {_newest(10, 'u')}"""))
def _(spark, d):
    bars = C.candles_from_ticks(tb.ticks_many(spark, d), DAY_MS).select("symbol", "open_time", "close")
    return M.newest_n(bars, 10)
