"""Order-book features and depth curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from ..functions.scalars import half_up
from ..schemas import LEVEL


def levels(pairs: Column) -> Column:
    """[[price, qty], ...] (numbers or strings) as an array of level structs; null becomes empty."""
    parsed = F.transform(pairs, lambda p: F.struct(
        p[0].cast("double").alias("price"), p[1].cast("double").alias("qty")))
    return F.coalesce(parsed, F.array().cast(T.ArrayType(LEVEL)))


def parse_levels(text) -> Column:
    """Levels from their JSON text."""
    return levels(F.from_json(text, "array<array<double>>"))


def _best(side: str) -> Column:
    return F.when(F.size(side) > 0, F.col(side)[0]["price"]).otherwise(F.lit(0.0))


def book_features(books: DataFrame) -> DataFrame:
    """Depth, best prices and spread; an empty side counts as 0 and leaves no spread."""
    both = (F.size("bids") > 0) & (F.size("asks") > 0)
    spread = half_up(_best("asks") - _best("bids"), 8)
    return books.select(
        *books.columns,
        F.size("bids").cast("bigint").alias("bid_depth"), F.size("asks").cast("bigint").alias("ask_depth"),
        _best("bids").alias("best_bid"), _best("asks").alias("best_ask"),
        F.when(both, spread).otherwise(F.lit(0.0)).alias("spread"))


def spread_percent(books: DataFrame) -> DataFrame:
    """Spread in percent of the best ask, 0 unless both sides are quoted."""
    both = (F.size("bids") > 0) & (F.size("asks") > 0)
    pct = (_best("asks") - _best("bids")) / _best("asks") * 100
    return books.withColumn("spread_pct", F.when(both, half_up(pct, 3)).otherwise(F.lit(0.0)))


def level_rows(books: DataFrame) -> DataFrame:
    """One row per level of books held as arrays."""
    def side(name: str, label: str) -> DataFrame:
        return books.select("symbol", "event_time", "last_update_id", F.lit(label).alias("side"),
                            F.posexplode(name).alias("pos", "lv")).select(
            "symbol", "event_time", "last_update_id", "side", (F.col("pos") + 1).cast("bigint").alias("level"),
            F.col("lv.price").alias("price"), F.col("lv.qty").alias("qty"))
    return side("bids", "bid").unionByName(side("asks", "ask"))


def level_features(levels: DataFrame) -> DataFrame:
    """Depth, best prices and spread of each book from its level rows; partly aggregated before the shuffle."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    sides = levels.groupBy("symbol", "event_time").agg(
        F.max("update_id").alias("last_update_id"),
        F.count_if(bid).alias("bid_depth"), F.count_if(ask).alias("ask_depth"),
        F.coalesce(F.max(F.when(bid, F.col("price"))), F.lit(0.0)).alias("best_bid"),
        F.coalesce(F.min(F.when(ask, F.col("price"))), F.lit(0.0)).alias("best_ask"))
    both = (F.col("bid_depth") > 0) & (F.col("ask_depth") > 0)
    gap = F.col("best_ask") - F.col("best_bid")
    return sides.withColumns({
        "spread": F.when(both, half_up(gap, 8)).otherwise(F.lit(0.0)),
        "spread_pct": F.when(both, half_up(gap / F.col("best_ask") * 100, 3)).otherwise(F.lit(0.0))})


def depth_curve(levels: DataFrame, keys=("symbol", "event_time")) -> DataFrame:
    """Levels of both sides with their running total and its share of the side, in percent.

    Works on level rows (side, level, price, qty): one shuffle by book and side, however deep a book is.
    """
    side = W.partitionBy(*keys, "side")
    running = side.orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = levels.withColumns({"_total": half_up(F.sum("qty").over(running), 4),
                               "_last": half_up(F.sum("qty").over(side), 4)})
    return rows.select(*keys, "side", "level", "price", half_up(F.col("qty"), 4).alias("amount"),
                       F.col("_total").alias("total"), (F.col("_total") / F.col("_last") * 100).alias("depth_pct"))


def synthetic_book(tickers: DataFrame) -> DataFrame:
    """A one-level book from a quoted ticker; tickers without both quotes give none."""
    def one(column: str) -> Column:
        return F.array(F.struct(F.col(column).alias("price"), F.lit(0.0).alias("qty")))

    return (tickers.filter((F.col("bid") > 0) & (F.col("ask") > 0))
            .select("symbol", "event_time", one("bid").alias("bids"), one("ask").alias("asks"),
                    F.col("bid").alias("best_bid"), F.col("ask").alias("best_ask"),
                    half_up(F.col("ask") - F.col("bid"), 8).alias("spread")))


def latest_book(books: DataFrame) -> DataFrame:
    values = [c for c in books.columns if c != "symbol"]
    picked = books.groupBy("symbol").agg(
        F.max_by(F.struct(*values), F.struct("event_time", "last_update_id")).alias("_row"))
    return picked.select("symbol", "_row.*")


def book_or_synthetic(symbols: DataFrame, books: DataFrame, tickers: DataFrame) -> DataFrame:
    """Stored book, else a synthetic one from the ticker, else no row."""
    fields = ("event_time", "bids", "asks", "best_bid", "best_ask", "spread")
    stored = book_features(books).select("symbol", F.struct(*fields).alias("_book"))
    fallback = synthetic_book(tickers).select("symbol", F.struct(*fields).alias("_synthetic"))
    found = (symbols.select("symbol").join(stored, "symbol", "left").join(fallback, "symbol", "left")
             .withColumn("_row", F.coalesce("_book", "_synthetic"))
             .filter(F.col("_row").isNotNull()))
    return found.select("symbol", "_row.*", F.col("_book").isNull().alias("is_synthetic"))
