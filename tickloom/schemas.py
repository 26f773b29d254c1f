"""Canonical record schemas and the fixed constants shared by every reader and operator."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _D, _S, _B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TICKER = _struct(
    ("event_time", _L), ("symbol", _S), ("close", _D), ("bid", _D), ("ask", _D),
    ("h24_open", _D), ("h24_high", _D), ("h24_low", _D), ("h24_volume", _D),
    ("h24_quote_volume", _D), ("h24_price_change", _D), ("h24_price_change_pct", _D),
    ("h24_trade_count", _L),
)
TRADE = _struct(
    ("event_time", _L), ("symbol", _S), ("agg_trade_id", _L), ("price", _D),
    ("quantity", _D), ("trade_time", _L), ("is_buyer_maker", _B),
)
KLINE = _struct(
    ("event_time", _L), ("symbol", _S), ("kline_start", _L), ("kline_close", _L),
    ("interval", _S), ("open", _D), ("high", _D), ("low", _D), ("close", _D),
    ("volume", _D), ("quote_volume", _D), ("trade_count", _L), ("is_closed", _B),
)
LEVEL = _struct(("price", _D), ("qty", _D))
DEPTH = _struct(
    ("event_time", _L), ("symbol", _S), ("last_update_id", _L),
    ("bids", T.ArrayType(LEVEL)), ("asks", T.ArrayType(LEVEL)),
)
#: A book as it travels in a topic: its levels are JSON text.
DEPTH_RECORD = _struct(("event_time", _L), ("symbol", _S), ("last_update_id", _L), ("bids", _S), ("asks", _S))
CANDLE = _struct(
    ("symbol", _S), ("open_time", _L), ("open", _D), ("high", _D), ("low", _D),
    ("close", _D), ("volume", _D),
)

def _message(*fields: tuple[str, str, T.DataType, T.DataType]) -> tuple[T.StructType, T.StructType]:
    """(shape as sent, same fields with canonical names and types), aligned by position.

    Message keys differ by case alone (``p``/``P``, ``t``/``T``), which column names cannot, so a
    message is parsed with the first shape and cast to the second one.
    """
    return (T.StructType([T.StructField(key, sent) for key, _, sent, _ in fields]),
            T.StructType([T.StructField(name, kind) for _, name, _, kind in fields]))


# Raw exchange messages: fixed key names. Every value is read as text first, so that one of a wrong type shows.
RAW_TICKER = _message(
    ("E", "event_time", _S, _L), ("s", "symbol", _S, _S), ("c", "close", _S, _D),
    ("b", "bid", _S, _D), ("a", "ask", _S, _D), ("o", "h24_open", _S, _D),
    ("h", "h24_high", _S, _D), ("l", "h24_low", _S, _D), ("v", "h24_volume", _S, _D),
    ("q", "h24_quote_volume", _S, _D), ("p", "h24_price_change", _S, _D),
    ("P", "h24_price_change_pct", _S, _D), ("n", "h24_trade_count", _S, _L),
)
RAW_TRADE = _message(
    ("E", "event_time", _S, _L), ("s", "symbol", _S, _S), ("a", "agg_trade_id", _S, _L),
    ("p", "price", _S, _D), ("q", "quantity", _S, _D), ("T", "trade_time", _S, _L),
    ("m", "is_buyer_maker", _S, _B),
)
_BODY = _message(
    ("t", "kline_start", _S, _L), ("T", "kline_close", _S, _L), ("i", "interval", _S, _S),
    ("o", "open", _S, _D), ("h", "high", _S, _D), ("l", "low", _S, _D), ("c", "close", _S, _D),
    ("v", "volume", _S, _D), ("q", "quote_volume", _S, _D), ("n", "trade_count", _S, _L),
    ("x", "is_closed", _S, _B),
)
RAW_KLINE = _message(
    ("E", "event_time", _S, _L), ("s", "symbol", _S, _S), ("k", "body", _BODY[0], _BODY[1]),
)
_PAIRS = T.ArrayType(T.ArrayType(_S))
RAW_DEPTH = _message(
    ("E", "event_time", _S, _L), ("s", "symbol", _S, _S), ("lastUpdateId", "snapshot_id", _S, _L),
    ("u", "update_id", _S, _L), ("bids", "bids", _PAIRS, _PAIRS), ("b", "bids_update", _PAIRS, _PAIRS),
    ("asks", "asks", _PAIRS, _PAIRS), ("a", "asks_update", _PAIRS, _PAIRS),
)

# Interval label -> seconds.
INTERVAL_SECONDS = {
    "1s": 1, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800,
}
INTERVAL_MS = {label: seconds * 1000 for label, seconds in INTERVAL_SECONDS.items()}

# Validation, quote-asset rules and point tags.
SYMBOL_PATTERN = "^[A-Z0-9]{1,20}$"
QUOTE_ASSET = "USDT"
EXCHANGE = "binance"
BACKFILL = "backfill"
BASE_SUFFIXES = ("USDT", "BUSD", "USDC", "BTC", "ETH", "BNB")

# Request bounds, thresholds and retention periods.
MINUTE_MS, HOUR_MS, DAY_MS = 60_000, 3_600_000, 86_400_000
MAX_KLINES, MAX_HISTORICAL, MAX_TRADES = 1500, 5000, 200
MAX_RANGE_MS = 365 * DAY_MS
MIN_GAP_MS = 300_000
GAP_LOOKBACK_MS = 7 * DAY_MS
HEARTBEAT_MS = 5_000
HISTORY_TRIM_MS = 300_000
# A symbol's tick history and its book are dropped as a whole this long after their last write.
HISTORY_TTL_MS, BOOK_TTL_MS = 600_000, 300_000
LISTING_EPOCH_MS = 1_500_000_000_000
STORE_RETENTION_MS = {"1s": 7 * DAY_MS, "1m": 90 * DAY_MS}
CACHE_RETENTION_MS = {"1s": DAY_MS, "1m": 7 * DAY_MS}
TARGET_FILE_BYTES = 128 * 1024 * 1024
MIN_INPUT_FILES = 5
POPULATE_DAYS = 90

# Windows of the candle operators are cut into blocks of this many steps, so that the longest
# series of one symbol is spread over many tasks (see operators/blocks.py).
BLOCK_STEPS = 512
TICK_BLOCK_MS = HOUR_MS
