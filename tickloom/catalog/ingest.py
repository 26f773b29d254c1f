"""Decoding, normalisation, routing, filters, validation and point projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import scalars as S
from ..operators import normalize as N
from ..operators.book import level_rows
from ..operators.merge import latest_per_symbol
from ..plans.serving import in_range, request_problem
from ..schemas import DAY_MS, DEPTH_RECORD, HOUR_MS, KLINE, LEVEL, MAX_HISTORICAL, MINUTE_MS, TICKER, TRADE
from ..session import fresh_dir
from ..sources import avro, lake, tables as tb, topics
from .registry import OHLCV, query, with_views

KLINE_COLS = """event_time, symbol, kline_start, kline_close, "interval", open, high, low, close, volume,
    quote_volume, trade_count, is_closed"""


def settled(klines: DataFrame) -> DataFrame:
    """Quote volume to four digits: more than its products have, so the sum order cannot show."""
    return klines.withColumn("quote_volume", F.round("quote_volume", 4))


def trades(spark, d) -> DataFrame:
    return tb.ticks(spark, d).select(
        "event_time", "symbol", F.col("seq").alias("agg_trade_id"), "price",
        F.col("volume").alias("quantity"), F.col("event_time").alias("trade_time"),
        (F.col("volume") >= 50).alias("is_buyer_maker"))


TRADES_SQL = """SELECT event_time, symbol, seq AS agg_trade_id, price, volume AS quantity,
    event_time AS trade_time, volume >= 50 AS is_buyer_maker FROM ticks"""

_NORMAL_TICKER_SQL = with_views("tickers", """SELECT event_time, symbol, close,
    CASE WHEN seq % 7 <> 0 THEN bid ELSE 0 END AS bid, CASE WHEN seq % 7 <> 0 THEN ask ELSE 0 END AS ask,
    0.0::DOUBLE AS h24_open, 0.0::DOUBLE AS h24_high, 0.0::DOUBLE AS h24_low,
    CASE WHEN seq % 7 <> 0 THEN h24_volume ELSE 0 END AS h24_volume,
    CASE WHEN seq % 7 <> 0 THEN h24_quote_volume ELSE 0 END AS h24_quote_volume,
    CASE WHEN seq % 7 <> 0 THEN h24_price_change ELSE 0 END AS h24_price_change,
    CASE WHEN seq % 7 <> 0 THEN h24_price_change_pct ELSE 0 END AS h24_price_change_pct,
    h24_trade_count FROM tickers""")

LEVELS_SQL = """SELECT symbol, event_time, CASE WHEN status = 'O' THEN 'bid' ELSE 'ask' END AS side, level,
    price, qty, max(okey) OVER (PARTITION BY symbol, event_time) AS last_update_id FROM levels"""


_GOOD = " AND ".join(f"{{seq}} % {n} <> 0" for n in (101, 103, 107, 109))


@query("normalized_tickers", "P1", f"{_NORMAL_TICKER_SQL} WHERE {_GOOD.format(seq='seq')}")
def _(spark, d):
    return N.normalize_tickers(tb.broken_messages(spark, d))


@query("normalized_trades", "P2 U4", with_views("ticks", TRADES_SQL))
def _(spark, d):
    return N.NORMALIZERS["trade"](tb.raw_trades(spark, d), column="payload")


@query("normalized_klines", "P3", with_views("k1h", f"SELECT {KLINE_COLS} FROM k1h"))
def _(spark, d):
    return settled(N.normalize_klines(tb.raw_klines(spark, d, "1h", HOUR_MS)))


@query("normalized_depth", "P4 B1", with_views("levels", LEVELS_SQL))
def _(spark, d):
    return level_rows(N.normalize_depth(tb.raw_depth(spark, d)))


@query("ticker_batches", "P5", _NORMAL_TICKER_SQL)
def _(spark, d):
    return N.explode_ticker_batches(tb.raw_ticker_batches(spark, d))


def _combined(spark, d) -> DataFrame:
    kinds = (tb.raw_trades(spark, d), tb.raw_klines(spark, d, "1h", HOUR_MS), tb.raw_depth(spark, d, True))
    first, *rest = [k.select("value") for k in kinds]
    for other in rest:
        first = first.unionByName(other)
    return first


@query("unwrapped_envelopes", "P6", with_views("ticks k1h levels", """
    SELECT 'aggTrade' AS event_type, symbol, count(*) AS n FROM ticks GROUP BY symbol
    UNION ALL SELECT 'kline', symbol, count(*) FROM k1h GROUP BY symbol
    UNION ALL SELECT 'depth', symbol, count(DISTINCT event_time) FROM levels GROUP BY symbol"""))
def _(spark, d):
    rows = N.unwrap_envelopes(_combined(spark, d))
    return rows.groupBy("event_type", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("routed_events", "P7", with_views("ticks k1h levels", """
    SELECT 'trade' AS topic, symbol, event_time FROM ticks
    UNION ALL SELECT 'kline', symbol, event_time FROM k1h
    UNION ALL SELECT DISTINCT 'depth', symbol, event_time FROM levels"""))
def _(spark, d):
    return N.routed(N.unwrap_envelopes(_combined(spark, d)), quote="").select("topic", "symbol", "event_time")


@query("malformed_messages", "P8", f"SELECT event_id AS seq, {_GOOD.format(seq='event_id')} AS is_good FROM events")
def _(spark, d):
    good, bad = N.split_malformed(tb.broken_messages(spark, d))
    return (good.select("seq", F.lit(True).alias("is_good"))
            .unionByName(bad.select("seq", F.lit(False).alias("is_good"))))


@query("framed_messages", "S2 S3", with_views("ticks", f"SELECT 7::BIGINT AS schema_id, * FROM ({TRADES_SQL})"))
def _(spark, d):
    return topics.decode_framed(topics.encode_framed(trades(spark, d), schema_id=7), TRADE)


RECORDS = {"ticker": (TICKER, 1), "trade": (TRADE, 2), "kline": (KLINE, 3), "depth": (DEPTH_RECORD, 4)}
AVRO = {number: avro.avro_schema(struct, kind) for kind, (struct, number) in RECORDS.items()}


def _records(spark, d) -> dict[str, DataFrame]:
    """Rows of the four record kinds."""
    tickers = tb.tickers(spark, d)
    tickers = tickers.select(*(F.col(f.name) if f.name in tickers.columns else F.lit(0.0).alias(f.name) for f in TICKER))
    depth = N.normalize_depth(tb.raw_depth(spark, d)).select(
        "event_time", "symbol", "last_update_id", F.to_json("bids").alias("bids"), F.to_json("asks").alias("asks"))
    return {"ticker": tickers, "trade": trades(spark, d), "kline": tb.klines(spark, d, "1h", HOUR_MS), "depth": depth}


def framed_records(spark, d) -> dict[str, DataFrame]:
    return {kind: avro.encode_records(rows, AVRO[RECORDS[kind][1]], RECORDS[kind][1]) for kind, rows in _records(spark, d).items()}


@query("avro_records", "S2 S3", with_views("tickers ticks k1h books", """SELECT 'ticker' AS kind, symbol, event_time, close AS x, h24_trade_count AS n FROM tickers
    UNION ALL SELECT 'trade', symbol, event_time, price, seq FROM ticks
    UNION ALL SELECT 'kline', symbol, event_time, close, trade_count FROM k1h
    UNION ALL SELECT 'depth', symbol, event_time, (bid_depth + ask_depth)::DOUBLE, last_update_id FROM books"""))
def _(spark, d):
    measure = {"ticker": ("close", "h24_trade_count"), "trade": ("price", "agg_trade_id"), "kline": ("close", "trade_count"), "depth": ("x", "last_update_id")}
    parts = []
    for kind, messages in framed_records(spark, d).items():
        rows = avro.decode_records(messages, AVRO, RECORDS[kind][0]).filter("malformed IS NULL")
        if kind == "depth":
            levels = [F.size(F.from_json(c, T.ArrayType(LEVEL))) for c in ("bids", "asks")]
            rows = rows.withColumn("x", (levels[0] + levels[1]).cast("double"))
        x, n = measure[kind]
        parts.append(rows.select(F.lit(kind).alias("kind"), "symbol", "event_time", F.col(x).alias("x"), F.col(n).alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("avro_malformed_frames", "S2 P8", with_views("ticks", """SELECT seq, CASE WHEN seq % 5 = 0 OR seq % 7 = 0 OR seq % 11 = 0 THEN NULL ELSE price END AS price,
    seq % 5 = 0 OR seq % 7 = 0 OR seq % 11 = 0 AS is_malformed FROM ticks"""))
def _(spark, d):
    # Cut short by a byte, of an unknown schema, of another magic byte; the key is the sequence number.
    framed = avro.encode_records(trades(spark, d).withColumn("seq", F.col("agg_trade_id")), AVRO[2], 2, key="seq")
    seq, value = F.col("key").cast("long"), F.col("value")
    body = F.expr("substring(value, 6, length(value) - 5)")
    broken = framed.withColumn("value", F.when(seq % 5 == 0, F.expr("substring(value, 1, length(value) - 1)"))
                               .when(seq % 7 == 0, F.concat(F.unhex(F.lit("00000000ff")), body))
                               .when(seq % 11 == 0, F.concat(F.unhex(F.lit("0100000002")), body)).otherwise(value))
    return avro.decode_records(broken, AVRO, TRADE, keep=("key",)).select(
        F.col("key").cast("long").alias("seq"), "price", F.col("malformed").isNotNull().alias("is_malformed"))


@query("declared_schema_read", "S4", with_views("k1h", f"SELECT {KLINE_COLS} FROM k1h"))
def _(spark, d):
    path = fresh_dir(spark, "declared-schema")
    tb.klines(spark, d, "1h", HOUR_MS).write.json(path)
    return settled(lake.read_records(spark, path, KLINE, "json"))


@query("positional_klines", "S5", with_views("k1m", f"""SELECT {KLINE_COLS} FROM
    (SELECT * REPLACE (kline_start AS event_time, true AS is_closed) FROM k1m)"""))
def _(spark, d):
    rows = tb.klines(spark, d, "1m", MINUTE_MS)
    order = ("kline_start", "open", "high", "low", "close", "volume", "kline_close", "quote_volume", "trade_count")
    value = F.to_json(F.array(*[F.col(c).cast("string") for c in order]))
    return settled(N.positional_klines(rows.select("symbol", value.alias("value"))))


@query("day_table", "S7 S8", with_views("k1m", f"""SELECT {OHLCV.replace('open_time', 'kline_start')},
    strftime(epoch_ms(kline_start), '%Y-%m-%d') AS day FROM k1m
    WHERE kline_start >= {tb.CUTOFF_MS - 5 * 86_400_000} AND kline_start < {tb.CUTOFF_MS}"""))
def _(spark, d):
    path = fresh_dir(spark, "kline-days")
    lake.append_sorted(tb.klines(spark, d, "1m", MINUTE_MS), path, "kline_start", lake.SORT_ORDER["kline"])
    table = in_range(spark.read.parquet(path), tb.CUTOFF_MS - 5 * 86_400_000, tb.CUTOFF_MS, "kline_start")
    return table.select("symbol", "kline_start", "open", "high", "low", "close", "volume",
                        F.col("dt").cast("string").alias("day"))


@query("tick_points", "S11", with_views("tickers", """SELECT symbol, 'binance' AS exchange, close AS price,
    bid, ask, h24_volume AS volume, h24_quote_volume AS quote_volume,
    h24_price_change_pct AS price_change_pct, h24_trade_count AS trade_count, event_time AS time FROM tickers"""))
def _(spark, d):
    return N.tick_points(tb.tickers(spark, d))


def all_klines(spark, d, since_ms=None, until_ms=None) -> DataFrame:
    """Klines of three intervals in one table."""
    seconds, minutes, hours = (tb.klines(spark, d, label, step, since_ms, until_ms)
                               for label, step in (("1s", 1000), ("1m", MINUTE_MS), ("1h", HOUR_MS)))
    return seconds.unionByName(minutes).unionByName(hours)


ALL_KLINES = "SELECT * FROM k1s UNION ALL SELECT * FROM k1m UNION ALL SELECT * FROM k1h"


@query("candle_points", "S12", with_views("k1s k1m k1h", f"""SELECT symbol, 'binance' AS exchange, "interval",
    open, high, low, close, volume, quote_volume, trade_count, is_closed, kline_start AS time
    FROM ({ALL_KLINES}) WHERE "interval" = '1m' AND is_closed"""))
def _(spark, d):
    return settled(N.candle_points(all_klines(spark, d)))


@query("candle_payloads", "S13", with_views("k1h", """SELECT symbol, "interval", kline_start, open, high, low,
    close, volume, quote_volume, trade_count, is_closed FROM k1h"""))
def _(spark, d):
    return settled(N.decode_candles(N.encode_candles(tb.klines(spark, d, "1h", HOUR_MS))))


@query("ad_hoc_sql", "S14", with_views("ticks c1h books", f"""SELECT s.symbol, n, top_price, bars, coalesce(books, 0) AS books
    FROM (SELECT symbol, count(*) AS n, max(price) FILTER (WHERE event_time >= {tb.CUTOFF_MS}) AS top_price FROM ticks GROUP BY symbol) s
    JOIN (SELECT symbol, count(*) AS bars FROM c1h GROUP BY symbol) USING (symbol)
    LEFT JOIN (SELECT symbol, count(*) AS books FROM books GROUP BY symbol) USING (symbol)"""))
def _(spark, d):
    views = tb.register_views(spark, d)
    return spark.sql("""SELECT s.symbol, n, top_price, bars, coalesce(books, 0) AS books
        FROM (SELECT symbol, count(*) AS n, max(price) FILTER (WHERE event_time >= :since) AS top_price FROM {ticks} GROUP BY symbol) s
        JOIN (SELECT symbol, count(*) AS bars FROM {candles_1h} GROUP BY symbol) USING (symbol)
        LEFT JOIN (SELECT symbol, count(*) AS books FROM {book_levels} WHERE level = 1 AND side = 'bid' GROUP BY symbol) USING (symbol)""".format(**views),
                     args={"since": tb.CUTOFF_MS})


@query("quote_asset_filter", "P9", with_views("ticks", """SELECT seq, symbol FROM
    (SELECT seq, CASE WHEN volume >= 50 THEN symbol ELSE replace(symbol, 'USDT', 'BTC') END AS symbol FROM ticks)
    WHERE symbol LIKE '%USDT'"""))
def _(spark, d):
    mixed = F.when(F.col("volume") >= 50, F.col("symbol")).otherwise(F.replace("symbol", F.lit("USDT"), F.lit("BTC")))
    return N.quote_filter(tb.ticks(spark, d).select("seq", mixed.alias("symbol")))


@query("tradable_symbols", "P10", with_views("symbols", """SELECT symbol FROM symbols
    WHERE quote = 'USDT' AND status = 'TRADING' AND spot"""))
def _(spark, d):
    return N.tradable_symbols(tb.symbols(spark, d))


@query("ingest_timestamps", "P11", with_views("ticks", """SELECT agg_trade_id,
    strftime(epoch_ms(event_time), '%Y-%m-%d %H:%M:%S.%g') AS event_timestamp, true AS stamped
    FROM (SELECT seq AS agg_trade_id, event_time FROM ticks)"""))
def _(spark, d):
    rows = lake.with_ingest_columns(trades(spark, d), "trade")
    same = (F.col("trade_timestamp") == F.col("event_timestamp")) & F.col("ingested_at").isNotNull()
    return rows.select("agg_trade_id", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_timestamp"),
                       same.alias("stamped"))


@query("rfc3339_times", "P12", with_views("ticks",
       "SELECT seq, strftime(epoch_ms(event_time), '%Y-%m-%dT%H:%M:%SZ') AS time FROM ticks"))
def _(spark, d):
    return tb.ticks(spark, d).select("seq", S.ms_to_rfc3339("event_time").alias("time"))


@query("chart_candles", "P13", with_views("c1h", """SELECT symbol, open_time // 1000 AS time, open, high, low,
    close, volume FROM c1h"""))
def _(spark, d):
    return tb.candles(spark, d, HOUR_MS).select("symbol", S.ms_to_seconds("open_time").alias("time"), "open",
                                                "high", "low", "close", "volume")


@query("null_key_rejection", "P14", with_views("ticks", """SELECT seq, event_time FROM ticks WHERE volume >= 10"""))
def _(spark, d):
    # The time is missing from low-volume rows.
    holes = tb.ticks(spark, d).select("seq", F.when(F.col("volume") >= 10, F.col("event_time")).alias("event_time"))
    return N.not_null(holes, "event_time")


@query("closed_minutes", "P15", with_views("k1s k1m k1h", f"""SELECT symbol, kline_start, close
    FROM ({ALL_KLINES}) WHERE "interval" = '1m' AND is_closed"""))
def _(spark, d):
    return N.closed_minutes(all_klines(spark, d)).select("symbol", "kline_start", "close")


def _requests(spark, d) -> DataFrame:
    """Symbols as users type them: spaced and lower-case, some with a character no symbol has."""
    e = tb.load(spark, d, "events")
    typed = F.concat(F.lit("  "), F.lower("event_type"), F.col("user_id").cast("string"),
                     F.when(F.col("value") >= 20, "/usdt").otherwise("usdt"), F.lit(" "))
    return e.select("event_id", typed.alias("symbol"))


@query("validated_symbols", "P16", """SELECT event_id,
    CASE WHEN ok THEN symbol ELSE '  ' || lower(symbol) || ' ' END AS symbol, ok AS is_valid FROM (
      SELECT event_id, symbol, regexp_full_match(symbol, '[A-Z0-9]{1,20}') AS ok FROM (
        SELECT event_id, upper(event_type) || user_id || CASE WHEN value >= 20 THEN '/USDT' ELSE 'USDT' END AS symbol
        FROM events))""")
def _(spark, d):
    return N.flag_symbols(_requests(spark, d))


@query("validated_requests", "P18", f"""SELECT event_id, CASE WHEN value >= 20 THEN 'Invalid symbol'
      WHEN "limit" NOT BETWEEN 1 AND {MAX_HISTORICAL} THEN 'limit must be between 1 and {MAX_HISTORICAL}'
      WHEN days <= 0 THEN 'end must be greater than start' WHEN days > 365 THEN 'range cannot exceed 1 year' END AS problem
    FROM (SELECT event_id, value, event_id % 60 * 100 - 200 AS "limit", user_id % 500 - 20 AS days FROM events)""")
def _(spark, d):
    at = S.to_ms("ts")
    days = (F.col("user_id") % 500 - 20).cast("bigint")
    extra = tb.load(spark, d, "events").select("event_id", at.alias("start_ms"), (at + days * DAY_MS).alias("end_ms"),
                                               (F.col("event_id") % 60 * 100 - 200).alias("limit"))
    requests = _requests(spark, d).join(extra, "event_id")
    return requests.select("event_id", request_problem(MAX_HISTORICAL).alias("problem"))


@query("validated_intervals", "P17", """SELECT event_id, "interval", CAST(CASE "interval" WHEN '1m' THEN 60
    WHEN '4h' THEN 14400 WHEN '1w' THEN 604800 END AS BIGINT) AS seconds FROM (
      SELECT event_id, CASE event_type WHEN 'click' THEN '1m' WHEN 'view' THEN '4h' WHEN 'error' THEN '1w'
      ELSE '2m' END AS "interval" FROM events) WHERE "interval" <> '2m'""")
def _(spark, d):
    typed = (F.when(F.col("event_type") == "click", " 1M ").when(F.col("event_type") == "view", "4H")
             .when(F.col("event_type") == "error", "1w").otherwise("2m"))
    return N.with_interval_seconds(tb.load(spark, d, "events").select("event_id", typed.alias("interval")))


@query("typed_candles", "P19", with_views("c1h", f"SELECT {OHLCV} FROM c1h"))
def _(spark, d):
    loose = tb.candles(spark, d, HOUR_MS)
    return N.typed_candles(loose.select(*[F.col(c).cast("string").alias(c) for c in loose.columns]))


@query("synthetic_ticks", "P20", with_views("k1h", """SELECT symbol, 'binance' AS exchange, 'backfill' AS source,
    close AS price, close AS bid, close AS ask, volume, quote_volume,
    CASE WHEN open <> 0 THEN (close - open) / open * 100 ELSE 0 END AS price_change_pct, trade_count,
    kline_start AS time FROM k1h"""))
def _(spark, d):
    return settled(N.synthetic_ticks(tb.klines(spark, d, "1h", HOUR_MS)))


@query("latest_ticker_view", "P21", with_views("latest", """SELECT symbol, price, change24h, bid, ask, volume,
    event_time FROM latest"""))
def _(spark, d):
    return N.latest_ticker_view(latest_per_symbol(tb.tickers(spark, d), "seq"))


@query("symbol_names", "P22", with_views("ticks", """SELECT DISTINCT symbol,
    regexp_replace(symbol, 'USDT$', ' / USDT') AS name, 'crypto' AS type FROM ticks
    UNION ALL SELECT DISTINCT replace(symbol, 'USDT', 'BTC'), replace(symbol, 'USDT', '') || ' / BTC', 'crypto' FROM ticks"""))
def _(spark, d):
    base = tb.symbols(spark, d).select("symbol")
    both = base.unionByName(base.select(F.replace("symbol", F.lit("USDT"), F.lit("BTC")).alias("symbol")))
    return both.distinct().select("symbol", S.display_name("symbol").alias("name"), F.lit("crypto").alias("type")).orderBy("symbol")


@query("base_assets", "P23", """SELECT event_id, pair, CASE
    WHEN pair LIKE '%_USDT' THEN left(pair, -4) WHEN pair LIKE '%_BUSD' THEN left(pair, -4)
    WHEN pair LIKE '%_USDC' THEN left(pair, -4) WHEN pair LIKE '%_BTC' THEN left(pair, -3)
    WHEN pair LIKE '%_ETH' THEN left(pair, -3) WHEN pair LIKE '%_BNB' THEN left(pair, -3) ELSE pair END AS base
    FROM (SELECT event_id, CASE WHEN value < 5 THEN 'USDT' WHEN value < 10 THEN upper(event_type) || 'BTCUSDT'
      WHEN value < 20 THEN upper(event_type) || 'ETH' WHEN value < 30 THEN upper(event_type) || 'EUR'
      ELSE upper(event_type) || 'BUSD' END AS pair FROM events)""")
def _(spark, d):
    name = F.upper("event_type")
    pair = (F.when(F.col("value") < 5, "USDT").when(F.col("value") < 10, F.concat(name, F.lit("BTCUSDT")))
            .when(F.col("value") < 20, F.concat(name, F.lit("ETH"))).when(F.col("value") < 30, F.concat(name, F.lit("EUR")))
            .otherwise(F.concat(name, F.lit("BUSD"))))
    return (tb.load(spark, d, "events").select("event_id", pair.alias("pair"))
            .select("event_id", "pair", S.base_asset("pair").alias("base")))


@query("symbol_search", "P24", with_views("ticks meta_old", """SELECT symbol, name FROM (
    SELECT DISTINCT symbol, name FROM ticks LEFT JOIN meta_old ON meta_old.base = replace(symbol, 'USDT', ''))
    WHERE contains(lower(symbol), 'ic') OR contains(lower(name), 'ok')"""))
def _(spark, d):
    from ..operators.lookup import with_metadata
    fallback, _fresh = tb.symbol_metadata(spark)
    named = with_metadata(tb.symbols(spark, d).select("symbol"), fallback)
    return named.filter(S.contains_ignoring_case("symbol", "IC") | S.contains_ignoring_case("name", "OK")).select("symbol", "name")


@query("up_down_flags", "P25", with_views("c1h", """SELECT symbol, open_time, close >= open AS is_up,
    CASE WHEN close > 0 THEN CASE WHEN close - open >= 0 THEN 'green' ELSE 'red' END ELSE 'gray' END AS color
    FROM c1h"""))
def _(spark, d):
    return tb.candles(spark, d, HOUR_MS).select(
        "symbol", "open_time", S.candle_is_up().alias("is_up"),
        S.ticker_color("close", F.col("close") - F.col("open"), F.lit("gray")).alias("color"))
