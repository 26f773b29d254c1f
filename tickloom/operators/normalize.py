"""Raw exchange messages to canonical records, and the projections written to stores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import (interval_seconds, normal_interval, normal_symbol, percent_change,
                                 symbol_is_valid)
from ..schemas import (BACKFILL, EXCHANGE, KLINE, QUOTE_ASSET, RAW_DEPTH, RAW_KLINE, RAW_TICKER, RAW_TRADE)
from .book import levels


def _parsed(messages: DataFrame, shape, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Message fields as typed columns with canonical names, all null where the text is not a JSON object.

    ``_wrong`` tells that a value is there but not of its type. ``inline`` makes the parse a plan
    node of its own, so filters on its columns cannot be pushed below it as a second parse.
    """
    sent, named = shape
    text = F.when(F.startswith(F.ltrim(F.col(column)), F.lit("{")), F.col(column))
    rows = messages.select(*keep, F.inline(F.array(F.from_json(text, sent).cast(_as_sent(shape)))))
    return _typed(rows, named, keep)


def _as_sent(shape) -> T.StructType:
    """Canonical names over the types as sent."""
    def nested(sent: T.StructType, named: T.StructType) -> T.StructType:
        return T.StructType([T.StructField(n.name, nested(s.dataType, n.dataType) if isinstance(s.dataType, T.StructType)
                                           else s.dataType) for s, n in zip(sent, named)])
    return nested(*shape)


def _values(named: T.StructType, of: Callable[[str], Column]) -> tuple[list[Column], Column]:
    """The typed fields of a message as sent, and whether one is there but not of its type."""
    wrong, columns = F.lit(False), []
    for f in named:
        value = of(f.name).try_cast(f.dataType)
        if isinstance(f.dataType, T.StructType):
            for inner in f.dataType:
                wrong = wrong | (of(f.name)[inner.name].isNotNull() & value[inner.name].isNull())
        else:
            wrong = wrong | (of(f.name).isNotNull() & value.isNull())
        columns.append(value.alias(f.name))
    return columns, wrong


def _typed(rows: DataFrame, named: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    columns, wrong = _values(named, F.col)
    return rows.select(*keep, *columns, wrong.alias("_wrong"))


def _once(**columns: Column) -> Column:
    """Columns that are computed in a plan node of their own, however often they are used."""
    return F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))


def _ticker_columns() -> list[Column]:
    """An absent optional number is 0; one that is there but no number has been rejected before."""
    optional = RAW_TICKER[1].fields[2:]
    return [F.col("event_time"), F.col("symbol"),
            *[F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name) for f in optional]]


def _depth_columns(received_ms: Column | None = None) -> list[Column]:
    """Snapshots carry ``bids`` and ``lastUpdateId``, updates ``b`` and ``u``."""
    now = F.unix_millis(F.current_timestamp()) if received_ms is None else received_ms

    def side(name: str) -> Column:
        return levels(F.when(F.size(name) > 0, F.col(name)).otherwise(F.col(f"{name}_update"))).alias(name)

    return [F.coalesce("event_time", now).alias("event_time"),
            F.upper(F.coalesce("symbol", F.lit(""))).alias("symbol"),
            F.coalesce("snapshot_id", "update_id", F.lit(0).cast("bigint")).alias("last_update_id"),
            side("bids"), side("asks")]


def normalize_tickers(messages: DataFrame, column: str = "value") -> DataFrame:
    rows = _parsed(messages, RAW_TICKER, column).filter("NOT _wrong").dropna(subset=["event_time", "symbol"])
    return rows.select(*_ticker_columns())


def normalize_trades(messages: DataFrame, column: str = "value") -> DataFrame:
    """All fields are required."""
    return _parsed(messages, RAW_TRADE, column).drop("_wrong").dropna()


def normalize_klines(messages: DataFrame, column: str = "value") -> DataFrame:
    """The nested kline body flattened; all fields are required."""
    rows = _parsed(messages, RAW_KLINE, column).select("event_time", "symbol", "body.*")
    return rows.dropna().select(*KLINE.fieldNames())


def normalize_depth(messages: DataFrame, column: str = "value",
                    received_ms: Column | None = None) -> DataFrame:
    rows = _parsed(messages, RAW_DEPTH, column).filter("NOT _wrong").drop("_wrong")
    return rows.dropna(how="all").select(*_depth_columns(received_ms))


# The exchange interface: one normaliser per record kind of a source.
NORMALIZERS: dict[str, Callable[..., DataFrame]] = {
    "ticker": normalize_tickers, "trade": normalize_trades,
    "kline": normalize_klines, "depth": normalize_depth,
}


def explode_ticker_batches(messages: DataFrame, column: str = "value",
                           quote: str = QUOTE_ASSET) -> DataFrame:
    """Array messages to one canonical ticker per element of the quote asset."""
    sent, named = RAW_TICKER
    rows = messages.select(F.inline(F.from_json(column, T.ArrayType(sent)).cast(T.ArrayType(_as_sent(RAW_TICKER)))))
    wanted = _typed(rows, named).filter("NOT _wrong").dropna(subset=["event_time"]).filter(F.col("symbol").endswith(quote))
    return wanted.select(*_ticker_columns())


def split_malformed(messages: DataFrame, column: str = "value", shape=RAW_TICKER) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows are not JSON, not an object, or hold a value that is not of its type."""
    is_object = F.try_parse_json(F.col(column)).isNotNull() \
        & F.startswith(F.ltrim(F.col(column)), F.lit("{"))
    flagged = _parsed(messages.withColumn("_is", F.coalesce(is_object, F.lit(False))), shape, column,
                      keep=[*messages.columns, "_is"])
    flagged = flagged.select(*messages.columns, (F.col("_is") & ~F.col("_wrong")).alias("_ok"))
    return (flagged.filter("_ok").drop("_ok"), flagged.filter("NOT _ok").drop("_ok"))


def unwrap_envelopes(messages: DataFrame, column: str = "value") -> DataFrame:
    """Payload, event type and symbol of combined-stream messages.

    The payload is the ``data`` member when there is one, else the message. A missing symbol comes
    from the stream name ``sym@...``; depth symbols are upper-cased.
    """
    envelope = messages.select("*", _once(_top=F.from_json(column, "map<string,string>")))
    rows = envelope.select(
        *messages.columns, F.col("_top")["stream"].alias("_stream"),
        F.coalesce(F.col("_top")["data"], F.col(column)).alias("payload"))
    rows = rows.select("*", _once(_body=F.from_json("payload", "map<string,string>"))).filter(F.col("_body").isNotNull())
    event, own = F.col("_body")["e"], F.col("_body")["s"]
    is_depth = F.col("_body")["lastUpdateId"].isNotNull() | F.coalesce(event == "depthUpdate", F.lit(False))
    from_stream = F.upper(F.split_part(F.coalesce("_stream", F.lit("")), F.lit("@"), F.lit(1)))
    return rows.select(
        *messages.columns, "payload",
        F.when(is_depth, F.lit("depth")).otherwise(event).alias("event_type"),
        F.when(is_depth, F.upper(F.coalesce(own, from_stream))).otherwise(own).alias("symbol"))


def routed(unwrapped: DataFrame, quote: str = QUOTE_ASSET) -> DataFrame:
    """All events in one frame: topic, symbol, event_time, and the record under the name of its topic (the others are null).

    Every payload is parsed once, with the shape of its own kind. Messages that are no record of their kind are left out.
    """
    topics = {"aggTrade": ("trade", RAW_TRADE), "kline": ("kline", RAW_KLINE), "depth": ("depth", RAW_DEPTH)}
    names = F.create_map(*[F.lit(x) for event, (topic, _) in topics.items() for x in (event, topic)])
    rows = unwrapped.filter(F.col("symbol").endswith(quote)).select(names[F.col("event_type")].alias("topic"), "symbol", "payload").filter("topic IS NOT NULL")
    own = lambda topic: F.when((F.col("topic") == topic) & F.startswith(F.ltrim("payload"), F.lit("{")), F.col("payload"))
    rows = rows.select("topic", "symbol", _once(**{
        f"_{topic}": F.from_json(own(topic), shape[0]).cast(_as_sent(shape)) for topic, shape in topics.values()}))
    trade, _ = _values(RAW_TRADE[1], lambda name: F.col("_trade")[name])
    kline, _ = _values(RAW_KLINE[1], lambda name: F.col("_kline")[name])
    depth, wrong = _values(RAW_DEPTH[1], lambda name: F.col("_depth")[name])
    rows = rows.select("topic", "symbol", _once(trade=F.struct(*trade), kline=F.struct(*kline), depth=F.struct(*depth), _wrong=wrong))
    body = [f"kline.body.{f.name}" for f in RAW_KLINE[1]["body"].dataType]
    complete = lambda fields: reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in fields))
    good = (F.when(F.col("topic") == "trade", complete(f"trade.{f}" for f in RAW_TRADE[1].names))
            .when(F.col("topic") == "kline", complete(["kline.event_time", "kline.symbol", *body])).otherwise(~F.col("_wrong")))
    own_symbol = F.when(F.col("topic") == "trade", F.col("trade.symbol")).when(F.col("topic") == "kline", F.col("kline.symbol")).otherwise(F.col("symbol"))
    own_time = F.when(F.col("topic") == "trade", F.col("trade.event_time")).when(F.col("topic") == "kline", F.col("kline.event_time")) \
        .otherwise(F.coalesce("depth.event_time", F.unix_millis(F.current_timestamp())))
    return rows.filter(good).select("topic", own_symbol.alias("symbol"), own_time.alias("event_time"),
                                    *(F.when(F.col("topic") == t, F.col(t)).alias(t) for t in ("trade", "kline", "depth")))


def route_events(unwrapped: DataFrame, quote: str = QUOTE_ASSET) -> dict[str, DataFrame]:
    """Canonical records per topic, each a selection of ``routed``; sinks that take all topics should share that frame."""
    rows = routed(unwrapped, quote)
    of = lambda topic: rows.filter(F.col("topic") == topic)
    # The symbol of a depth message is the unwrapped one: snapshots do not carry it.
    depth = of("depth").select("depth.*", F.col("symbol").alias("_symbol")).withColumn("symbol", F.col("_symbol"))
    return {"trade": of("trade").select("trade.*"),
            "kline": of("kline").select("kline.event_time", "kline.symbol", "kline.body.*").select(*KLINE.fieldNames()),
            "depth": depth.select(*_depth_columns())}


def quote_filter(df: DataFrame, quote: str = QUOTE_ASSET) -> DataFrame:
    return df.filter(F.col("symbol").endswith(quote))


def tradable_symbols(symbols: DataFrame, quote: str = QUOTE_ASSET, first: int | None = None) -> DataFrame:
    """Spot-tradable symbols of a quote asset, sorted; ``first`` keeps the first N."""
    chosen = (symbols.filter((F.col("quote") == quote) & (F.col("status") == "TRADING")
                             & F.coalesce("spot", F.lit(False)))
              .select("symbol").orderBy("symbol"))
    return chosen if first is None else chosen.limit(first)


def positional_klines(rows: DataFrame, column: str = "value") -> DataFrame:
    """Positional kline arrays to canonical closed one-minute klines."""
    k = F.from_json(column, "array<string>")

    def at(index: int, kind: str) -> Column:
        return F.try_element_at(F.col("_k"), F.lit(index + 1)).try_cast(kind)

    named = rows.withColumn("_k", k).select(
        at(0, "bigint").alias("event_time"), "symbol", at(0, "bigint").alias("kline_start"),
        at(6, "bigint").alias("kline_close"), F.lit("1m").alias("interval"),
        at(1, "double").alias("open"), at(2, "double").alias("high"), at(3, "double").alias("low"),
        at(4, "double").alias("close"), at(5, "double").alias("volume"),
        at(7, "double").alias("quote_volume"), at(8, "bigint").alias("trade_count"),
        F.lit(True).alias("is_closed"))
    return named.dropna().select(*KLINE.fieldNames())


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def closed_minutes(klines: DataFrame) -> DataFrame:
    return klines.filter((F.col("interval") == "1m") & F.col("is_closed"))


def flag_symbols(requests: DataFrame) -> DataFrame:
    """Requests with ``is_valid``; the valid ones with their normalised symbol, the others as given."""
    ok = symbol_is_valid("symbol")
    return requests.withColumn("is_valid", ok).withColumn(
        "symbol", F.when(F.col("is_valid"), normal_symbol("symbol")).otherwise(F.col("symbol")))


def split_symbols(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid with normalised symbol, rejected as given)."""
    flagged = flag_symbols(requests)
    return flagged.filter("is_valid").drop("is_valid"), flagged.filter("NOT is_valid").drop("is_valid")


def with_interval_seconds(requests: DataFrame) -> DataFrame:
    """Normalised interval with its seconds; unsupported intervals are dropped."""
    return (requests.withColumn("seconds", interval_seconds("interval"))
            .withColumn("interval", normal_interval("interval"))
            .filter(F.col("seconds").isNotNull()))


def typed_candles(rows: DataFrame) -> DataFrame:
    """Loosely typed candle tuples to the candle types."""
    doubles = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return rows.select("symbol", F.col("open_time").cast("bigint").alias("open_time"), *doubles)


def synthetic_ticks(klines: DataFrame) -> DataFrame:
    """Backfill ticks from klines: every quote is the close."""
    return klines.select(
        "symbol", F.lit(EXCHANGE).alias("exchange"), F.lit(BACKFILL).alias("source"),
        F.col("close").alias("price"), F.col("close").alias("bid"), F.col("close").alias("ask"),
        "volume", "quote_volume", percent_change("open", "close").alias("price_change_pct"),
        "trade_count", F.col("kline_start").alias("time"))


def tick_points(tickers: DataFrame) -> DataFrame:
    return tickers.select(
        "symbol", F.lit(EXCHANGE).alias("exchange"), F.col("close").alias("price"), "bid", "ask",
        F.col("h24_volume").alias("volume"), F.col("h24_quote_volume").alias("quote_volume"),
        F.col("h24_price_change_pct").alias("price_change_pct"),
        F.col("h24_trade_count").alias("trade_count"), F.col("event_time").alias("time"))


def candle_points(klines: DataFrame) -> DataFrame:
    return closed_minutes(klines).select(
        "symbol", F.lit(EXCHANGE).alias("exchange"), "interval", "open", "high", "low", "close",
        "volume", "quote_volume", "trade_count", "is_closed", F.col("kline_start").alias("time"))


def latest_ticker_view(latest: DataFrame) -> DataFrame:
    """The served ticker: absent numbers read as 0."""
    def zero(source: str, name: str) -> Column:
        return F.coalesce(F.col(source), F.lit(0.0)).alias(name)

    return latest.select(
        F.upper("symbol").alias("symbol"), zero("close", "price"),
        zero("h24_price_change_pct", "change24h"), zero("bid", "bid"), zero("ask", "ask"),
        zero("h24_volume", "volume"), F.coalesce("event_time", F.lit(0).cast("bigint")).alias("event_time"))


PAYLOAD = "t bigint, o double, h double, l double, c double, v double, qv double, n bigint, x boolean"
_PAYLOAD_COLS = (("t", "kline_start"), ("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"),
                 ("v", "volume"), ("qv", "quote_volume"), ("n", "trade_count"), ("x", "is_closed"))


def encode_candles(klines: DataFrame) -> DataFrame:
    """Cache payload per kline."""
    body = F.struct(*[F.col(name).alias(key) for key, name in _PAYLOAD_COLS])
    return klines.select("symbol", "interval", F.to_json(body).alias("payload"))


def decode_candles(payloads: DataFrame) -> DataFrame:
    body = payloads.withColumn("_p", F.from_json("payload", PAYLOAD))
    return body.select("symbol", "interval", *[F.col(f"_p.{key}").alias(name) for key, name in _PAYLOAD_COLS])
