"""Market-shaped views over the generic benchmark tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import to_ms
from ..operators.candles import candles_from_ticks

NOW_MS = 1_706_616_000_000      # 2024-01-30 12:00 UTC: the fixed "now" of all relative queries
CUTOFF_MS = 1_705_320_000_000   # 2024-01-15 12:00 UTC: hot tier starts here
OVERLAP_MS = 86_400_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Events as price ticks; ``seq`` ascends with time and is unique."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.upper("event_type"), F.lit("USDT")).alias("symbol"),
        to_ms("ts").alias("event_time"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"))


def _at(ms: int) -> Column:
    return F.timestamp_millis(F.lit(ms)).cast("timestamp_ntz")


def ticks(spark: SparkSession, sf_dir: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Events as ticks, those of ``since <= time < until``; the range is compared on the stored column."""
    events = load(spark, sf_dir, "events")
    if since_ms is not None:
        events = events.filter(F.col("ts") >= _at(since_ms))
    if until_ms is not None:
        events = events.filter(F.col("ts") < _at(until_ms))
    return ticks_from_events(events)


def ticks_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ticks with one symbol per user: many short series."""
    events = load(spark, sf_dir, "events")
    return ticks_from_events(events.withColumn("event_type", F.concat(F.lit("U"), F.col("user_id").cast("string"))))


def line_sequence() -> Column:
    """(ship date, order, line, part) as one number that sorts the same way.

    One fixed-width value keeps ``min_by``/``max_by`` in a hash aggregate, where a struct would make
    Spark sort. The digits per key add up to the 38 a decimal has; a wider value is an error.
    """
    def digits(column, n: int) -> Column:
        return column.cast(f"decimal({n},0)")

    head = digits(to_ms("l_shipdate"), 13) * digits(F.lit(10 ** 12), 13) + digits(F.col("l_orderkey"), 12)
    tail = F.col("l_linenumber").cast("bigint") * F.lit(10 ** 11) + F.col("l_partkey")
    return (head.cast("decimal(25,0)") * digits(F.lit(10 ** 13), 14)
            + digits(tail, 13)).cast("decimal(38,0)")


def ticks_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks of their supplier; ``seq`` orders them uniquely."""
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        to_ms("l_shipdate").alias("event_time"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"), line_sequence().alias("seq"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ticks of their priority, in the order of (order date, order key)."""
    at = to_ms("o_orderdate")
    seq = at.cast("decimal(13,0)") * F.lit(10 ** 12).cast("decimal(13,0)") + F.col("o_orderkey").cast("decimal(12,0)")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), at.alias("event_time"),
        F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), seq.cast("decimal(38,0)").alias("seq"))


def _steps(step_ms: int, since_ms: int | None, until_ms: int | None) -> tuple[int | None, int | None]:
    """The range of ticks behind the steps that start in ``[since, until)``."""
    def up(ms: int | None) -> int | None:
        return None if ms is None else -(-ms // step_ms) * step_ms
    return up(since_ms), up(until_ms)


def candles(spark: SparkSession, sf_dir: str, step_ms: int, since_ms: int | None = None,
            until_ms: int | None = None) -> DataFrame:
    """Candles with ``since <= open_time < until``; only their ticks are read."""
    return (candles_from_ticks(ticks(spark, sf_dir, *_steps(step_ms, since_ms, until_ms)), step_ms)
            .select("symbol", "open_time", "open", "high", "low", "close", "volume"))


def klines(spark: SparkSession, sf_dir: str, interval: str, step_ms: int, since_ms: int | None = None,
           until_ms: int | None = None) -> DataFrame:
    """Canonical klines built from ticks; those ending after ``NOW_MS`` are still open."""
    end = F.col("open_time") + step_ms - 1
    return candles_from_ticks(ticks(spark, sf_dir, *_steps(step_ms, since_ms, until_ms)), step_ms).select(
        end.alias("event_time"), "symbol", F.col("open_time").alias("kline_start"),
        end.alias("kline_close"), F.lit(interval).alias("interval"), "open", "high", "low", "close",
        "volume", "quote_volume", "trade_count", (end < NOW_MS).alias("is_closed"))


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical tickers, one per tick; quotes are one tenth of a percent around the price."""
    price, volume = F.col("price"), F.col("volume")
    return ticks(spark, sf_dir).select(
        "event_time", "symbol", price.alias("close"), (price * 0.999).alias("bid"),
        (price * 1.001).alias("ask"), volume.alias("h24_volume"),
        (price * volume).alias("h24_quote_volume"), (price - 50.0).alias("h24_price_change"),
        ((price - 50.0) / 50.0 * 100.0).alias("h24_price_change_pct"),
        F.lit(1).cast("bigint").alias("h24_trade_count"), "seq")


def latest_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest ticker per symbol in its served form."""
    from ..operators.merge import latest_per_symbol
    return latest_per_symbol(tickers(spark, sf_dir), "seq").select(
        "symbol", F.col("close").alias("price"), "bid", "ask", F.col("h24_volume").alias("volume"),
        F.col("h24_price_change_pct").alias("change24h"), "event_time")


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as book levels: 'O' lines are bids, 'F' lines asks; ``p``, ``q`` sort best first on either side."""
    sign = F.when(F.col("l_linestatus") == "O", F.lit(-1.0)).otherwise(F.lit(1.0))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        to_ms("l_shipdate").alias("event_time"),
        F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"),
        price.alias("price"), F.col("l_quantity").alias("qty"), F.col("l_orderkey").alias("update_id"),
        (price * sign).alias("p"), (F.col("l_quantity") * sign).alias("q"))


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level of every book as a row, numbered from the best one of its side."""
    w = W.partitionBy("symbol", "event_time", "side").orderBy("p", "q", "update_id")
    return _quoted(spark, sf_dir).withColumn("level", F.row_number().over(w).cast("bigint")).drop("p", "q")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book per supplier and ship date as a message carries it: whole sides, best levels first."""
    rank = F.struct("p", "q", "update_id", "price", "qty")

    def side(label: str) -> Column:
        ranked = F.sort_array(F.collect_list(F.when(F.col("side") == label, rank)))
        return F.transform(ranked, lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))

    return _quoted(spark, sf_dir).groupBy("event_time", "symbol").agg(
        F.max("update_id").alias("last_update_id"), side("bid").alias("bids"), side("ask").alias("asks"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known symbols with listing flags."""
    names = ticks(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return names.select(
        "symbol", F.lit("USDT").alias("quote"),
        F.when(F.col("symbol") == "ERRORUSDT", "BREAK").otherwise("TRADING").alias("status"),
        (F.col("symbol") != "VIEWUSDT").alias("spot"))


def hot(spark: SparkSession, sf_dir: str, step_ms: int, since_ms: int | None = None,
        until_ms: int | None = None) -> DataFrame:
    start = CUTOFF_MS - OVERLAP_MS
    return candles(spark, sf_dir, step_ms, start if since_ms is None else max(start, since_ms), until_ms)


def cold(spark: SparkSession, sf_dir: str, step_ms: int, since_ms: int | None = None,
         until_ms: int | None = None) -> DataFrame:
    """The older tier; its volume is one higher, so that the winner of a merge shows."""
    end = CUTOFF_MS if until_ms is None else min(CUTOFF_MS, until_ms)
    return candles(spark, sf_dir, step_ms, since_ms, end).withColumn("volume", F.col("volume") + 1)


def register_views(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Every market view as a temporary view for ad-hoc SQL: {name: view}."""
    views = {"ticks": ticks(spark, sf_dir), "ticks_big": ticks_big(spark, sf_dir), "orders": order_ticks(spark, sf_dir),
             "tickers": tickers(spark, sf_dir), "latest_tickers": latest_tickers(spark, sf_dir),
             "book_levels": book_levels(spark, sf_dir), "symbols": symbols(spark, sf_dir)}
    for label, step in (("1s", 1000), ("1m", 60_000), ("1h", 3_600_000)):
        views[f"candles_{label}"] = candles(spark, sf_dir, step)
        views[f"klines_{label}"] = klines(spark, sf_dir, label, step)
    for name, df in views.items():
        df.createOrReplaceTempView(f"market_{name}")
    return {name: f"market_{name}" for name in views}


# ---------------------------------------------------------------- raw exchange messages

def _text(column: str) -> Column:
    return F.col(column).cast("string")


def raw_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker messages; every seventh lacks its optional keys."""
    rows = tickers(spark, sf_dir)
    full = F.col("seq") % 7 != 0

    def opt(column: str) -> Column:
        return F.when(full, _text(column))

    body = F.struct(
        F.col("event_time").alias("E"), F.col("symbol").alias("s"), _text("close").alias("c"),
        opt("bid").alias("b"), opt("ask").alias("a"), opt("h24_volume").alias("v"),
        opt("h24_quote_volume").alias("q"), opt("h24_price_change").alias("p"),
        opt("h24_price_change_pct").alias("P"), F.col("h24_trade_count").alias("n"))
    return rows.select("seq", "symbol", "event_time", F.to_json(body).alias("value"))


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade messages in a combined-stream envelope."""
    rows = ticks(spark, sf_dir)
    body = F.struct(
        F.lit("aggTrade").alias("e"), F.col("event_time").alias("E"), F.col("symbol").alias("s"),
        F.col("seq").alias("a"), _text("price").alias("p"), _text("volume").alias("q"),
        F.col("event_time").alias("T"), (F.col("volume") >= 50).alias("m"))
    stream = F.concat(F.lower("symbol"), F.lit("@aggTrade"))
    return rows.select("seq", F.to_json(body).alias("payload"),
                       F.to_json(F.struct(stream.alias("stream"), body.alias("data"))).alias("value"))


def raw_klines(spark: SparkSession, sf_dir: str, interval: str, step_ms: int) -> DataFrame:
    rows = klines(spark, sf_dir, interval, step_ms)
    body = F.struct(
        F.col("kline_start").alias("t"), F.col("kline_close").alias("T"), F.col("interval").alias("i"),
        _text("open").alias("o"), _text("high").alias("h"), _text("low").alias("l"),
        _text("close").alias("c"), _text("volume").alias("v"), _text("quote_volume").alias("q"),
        F.col("trade_count").alias("n"), F.col("is_closed").alias("x"))
    message = F.struct(F.lit("kline").alias("e"), F.col("event_time").alias("E"),
                       F.col("symbol").alias("s"), body.alias("k"))
    return rows.select(F.to_json(message).alias("value"))


def raw_depth(spark: SparkSession, sf_dir: str, enveloped: bool = False) -> DataFrame:
    """Book messages: snapshots without a symbol inside envelopes, updates with short keys."""
    rows = books(spark, sf_dir)

    def pairs(side: str) -> Column:
        return F.transform(side, lambda x: F.array(x["price"].cast("string"), x["qty"].cast("string")))

    update = F.col("last_update_id") % 2 == 0
    body = F.struct(
        F.when(update, F.lit("depthUpdate")).alias("e"), F.col("event_time").alias("E"),
        F.when(update | F.lit(not enveloped), F.lower("symbol")).alias("s"),
        F.when(~update, F.col("last_update_id")).alias("lastUpdateId"),
        F.when(update, F.col("last_update_id")).alias("u"),
        F.when(~update, pairs("bids")).alias("bids"), F.when(update, pairs("bids")).alias("b"),
        F.when(~update, pairs("asks")).alias("asks"), F.when(update, pairs("asks")).alias("a"))
    if not enveloped:
        return rows.select(F.to_json(body).alias("value"))
    stream = F.concat(F.lower("symbol"), F.lit("@depth20@100ms"))
    return rows.select(F.to_json(F.struct(stream.alias("stream"), body.alias("data"))).alias("value"))


def raw_ticker_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array messages of at most 100 consecutive ticks."""
    rows = raw_tickers(spark, sf_dir).withColumn("batch", F.expr("seq div 100"))
    grouped = rows.groupBy("batch").agg(F.concat_ws(",", F.collect_list("value")).alias("items"))
    return grouped.select(F.concat(F.lit("["), F.col("items"), F.lit("]")).alias("value"))


def broken_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker messages of which some are cut short, some are arrays and some hold a price that is no number."""
    rows = raw_tickers(spark, sf_dir)
    value = (F.when(F.col("seq") % 101 == 0, F.expr("substring(value, 1, length(value) - 1)"))
             .when(F.col("seq") % 103 == 0, F.concat(F.lit("["), F.col("value"), F.lit("]")))
             .when(F.col("seq") % 107 == 0, F.regexp_replace("value", '"c":"[^"]*"', '"c":"abc"'))
             .when(F.col("seq") % 109 == 0, F.regexp_replace("value", '"n":[0-9]+', '"n":{"x":1}'))
             .otherwise(F.col("value")))
    return rows.select("seq", value.alias("value"))


def symbol_metadata(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(fallback, fresh) display names by base asset: two fixed dimension tables."""
    fallback = [("CLICK", "Click Coin"), ("VIEW", "View Token"), ("PURCHASE", "Purchase"),
                ("SIGNUP", "Signup")]
    fresh = [("VIEW", "Viewcoin"), ("ERROR", "Error Token")]
    schema = "base string, name string"
    return spark.createDataFrame(fallback, schema), spark.createDataFrame(fresh, schema)

