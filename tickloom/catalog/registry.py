"""Registered queries: name, covered operators, Spark plan and independent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schemas import DAY_MS, HOUR_MS, MINUTE_MS
from ..sources.tables import CUTOFF_MS, NOW_MS, OVERLAP_MS


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Zone-less timestamps of the tables are UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = Query(name, tuple(covers.split()), run, sql)
        return fn
    return register


def candles_sql(step_ms: int, source: str = "ticks") -> str:
    return f"""SELECT symbol, event_time - event_time % {step_ms} AS open_time,
        arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, seq) AS close, sum(volume) AS volume,
        sum(price * volume) AS quote_volume, count(*) AS trade_count
        FROM {source} GROUP BY 1, 2"""


def klines_sql(label: str, step_ms: int) -> str:
    return f"""SELECT open_time + {step_ms - 1} AS event_time, symbol, open_time AS kline_start,
        open_time + {step_ms - 1} AS kline_close, '{label}' AS "interval", open, high, low, close,
        volume, round(quote_volume, 4) AS quote_volume, trade_count,
        open_time + {step_ms - 1} < {NOW_MS} AS is_closed FROM ({candles_sql(step_ms)})"""


# Common table expressions over the driver tables, in dependency order.
_CTES = {
    "ticks": """SELECT event_id AS seq, upper(event_type) || 'USDT' AS symbol, epoch_us(ts) // 1000 AS event_time,
        value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events""",
    "ticks_many": """SELECT event_id AS seq, 'U' || user_id || 'USDT' AS symbol, epoch_us(ts) // 1000 AS event_time,
        value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events""",
    "ticks_big": """SELECT 'S' || l_suppkey AS symbol, epoch_us(l_shipdate) // 1000 AS event_time,
        l_extendedprice / l_quantity AS price, l_quantity AS volume, l_orderkey, l_linenumber,
        l_partkey FROM lineitem""",
    "order_ticks": """SELECT o_orderpriority AS symbol, epoch_us(o_orderdate) // 1000 AS event_time,
        o_totalprice AS price, 1.0::DOUBLE AS volume, o_orderkey AS seq FROM orders""",
    "c1h": candles_sql(HOUR_MS),
    "c1m": candles_sql(MINUTE_MS),
    "c1s": candles_sql(1000),
    "k1h": klines_sql("1h", HOUR_MS),
    "k1m": klines_sql("1m", MINUTE_MS),
    "k1s": klines_sql("1s", 1000),
    "hot": f"""SELECT symbol, open_time, open, high, low, close, volume FROM c1h
        WHERE open_time >= {CUTOFF_MS - OVERLAP_MS}""",
    "cold": f"""SELECT symbol, open_time, open, high, low, close, volume + 1 AS volume FROM c1h
        WHERE open_time < {CUTOFF_MS}""",
    "hot1m": f"""SELECT symbol, open_time, open, high, low, close, volume FROM c1m
        WHERE open_time >= {CUTOFF_MS - OVERLAP_MS}""",
    "cold1m": f"""SELECT symbol, open_time, open, high, low, close, volume + 1 AS volume FROM c1m
        WHERE open_time < {CUTOFF_MS}""",
    "tickers": """SELECT event_time, symbol, price AS close, price * 0.999::DOUBLE AS bid,
        price * 1.001::DOUBLE AS ask, volume AS h24_volume, price * volume AS h24_quote_volume,
        price - 50.0::DOUBLE AS h24_price_change,
        (price - 50.0::DOUBLE) / 50.0::DOUBLE * 100.0::DOUBLE AS h24_price_change_pct,
        1::BIGINT AS h24_trade_count, seq FROM ticks""",
    "latest": """SELECT symbol, close AS price, bid, ask, h24_volume AS volume,
        h24_price_change_pct AS change24h, event_time FROM tickers
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1""",
    "levels": """SELECT symbol, event_time, status, price, qty, okey,
        row_number() OVER (PARTITION BY symbol, event_time, status ORDER BY sign * price, sign * qty, okey) AS level
        FROM (SELECT 'S' || l_suppkey AS symbol, epoch_us(l_shipdate) // 1000 AS event_time, l_linestatus AS status,
              l_extendedprice / l_quantity AS price, l_quantity AS qty, l_orderkey AS okey,
              CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END AS sign FROM lineitem)""",
    "books": """SELECT symbol, event_time, max(okey) AS last_update_id,
        count(*) FILTER (WHERE status = 'O') AS bid_depth, count(*) FILTER (WHERE status = 'F') AS ask_depth,
        max(price) FILTER (WHERE status = 'O') AS bid1, min(price) FILTER (WHERE status = 'F') AS ask1
        FROM levels GROUP BY 1, 2""",
    "symbols": """SELECT DISTINCT symbol, 'USDT' AS quote,
        CASE WHEN symbol = 'ERRORUSDT' THEN 'BREAK' ELSE 'TRADING' END AS status,
        symbol <> 'VIEWUSDT' AS spot FROM ticks""",
    "meta_old": """SELECT * FROM (VALUES ('CLICK', 'Click Coin'), ('VIEW', 'View Token'),
        ('PURCHASE', 'Purchase'), ('SIGNUP', 'Signup')) AS t(base, name)""",
    "meta_new": "SELECT * FROM (VALUES ('VIEW', 'Viewcoin'), ('ERROR', 'Error Token')) AS t(base, name)",
}

_NEEDS = {
    "c1h": "ticks", "c1m": "ticks", "c1s": "ticks", "k1h": "ticks", "k1m": "ticks", "k1s": "ticks",
    "hot": "c1h", "cold": "c1h", "hot1m": "c1m", "cold1m": "c1m", "tickers": "ticks",
    "latest": "tickers", "books": "levels", "symbols": "ticks",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the named views and everything they need; extra views may open the body.

    A body that starts with a comma continues the list of views.
    """
    wanted: set[str] = set()

    def need(name: str) -> None:
        if name in _NEEDS:
            need(_NEEDS[name])
        wanted.add(name)

    for name in names.split():
        need(name)
    views = ", ".join(f"{name} AS ({_CTES[name]})" for name in _CTES if name in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{body if body.lstrip().startswith(',') else ' ' + body}"


OHLCV = "symbol, open_time, open, high, low, close, volume"
DAY = DAY_MS
