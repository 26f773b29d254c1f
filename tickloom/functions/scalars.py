"""Column expressions: time conversion, bucketing, validation, naming and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import BASE_SUFFIXES, INTERVAL_SECONDS, SYMBOL_PATTERN


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bucket(t, step_ms: int) -> Column:
    """Start of the epoch-aligned bucket holding ``t``; weeks therefore begin on Thursday."""
    t = as_col(t)
    return t - F.pmod(t, F.lit(step_ms).cast("bigint"))


def ms_to_timestamp(t) -> Column:
    return F.timestamp_millis(as_col(t))


def ms_to_rfc3339(t) -> Column:
    return F.date_format(F.timestamp_millis(as_col(t)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ms_to_seconds(t) -> Column:
    t = as_col(t)
    return F.floor((t - F.pmod(t, F.lit(1000).cast("bigint"))) / F.lit(1000)).cast("bigint")


def to_ms(ts) -> Column:
    """Epoch milliseconds of a timestamp, zone-less ones included (session zone is UTC)."""
    return F.unix_millis(as_col(ts).cast("timestamp"))


def half_up(value, digits: int) -> Column:
    """Decimal rounding as ``floor(x * 10^n + 0.5) / 10^n``: the same bits in every engine."""
    scale = F.lit(float(10 ** digits))
    return F.floor(as_col(value) * scale + F.lit(0.5)).cast("double") / scale


def normal_symbol(symbol) -> Column:
    return F.upper(F.trim(as_col(symbol)))


def symbol_is_valid(symbol) -> Column:
    return F.coalesce(normal_symbol(symbol).rlike(SYMBOL_PATTERN), F.lit(False))


def normal_interval(interval) -> Column:
    return F.lower(F.trim(as_col(interval)))


def interval_seconds(interval) -> Column:
    """Seconds of an interval label, null for an unsupported one."""
    pairs = [F.lit(x) for label, sec in INTERVAL_SECONDS.items() for x in (label, sec)]
    return F.try_element_at(F.create_map(*pairs), normal_interval(interval)).cast("bigint")


def display_name(symbol) -> Column:
    symbol = as_col(symbol)

    def spaced(quote: str) -> Column:
        base = F.substring(symbol, F.lit(1), F.length(symbol) - F.lit(len(quote)))
        return F.concat(base, F.lit(f" / {quote}"))

    return (F.when(symbol.endswith("USDT"), spaced("USDT"))
            .when(symbol.endswith("BTC"), spaced("BTC"))
            .otherwise(symbol))


def base_asset(pair) -> Column:
    """The pair without its quote suffix; suffixes are tried in order, never eating the whole."""
    pair = as_col(pair)
    out = None
    for suffix in BASE_SUFFIXES:
        hit = pair.endswith(suffix) & (F.length(pair) > len(suffix))
        base = F.substring(pair, F.lit(1), F.length(pair) - F.lit(len(suffix)))
        out = F.when(hit, base) if out is None else out.when(hit, base)
    return out.otherwise(pair)


def contains_ignoring_case(column, query: str) -> Column:
    return F.lower(as_col(column)).contains(query.lower())


def candle_is_up(open_="open", close="close") -> Column:
    return as_col(close) >= as_col(open_)


def ticker_color(price, change, current) -> Column:
    """Green or red by the 24-hour change once a price is known, else the current colour."""
    change = F.coalesce(as_col(change), F.lit(0.0))
    return (F.when(as_col(price) > 0, F.when(change >= 0, F.lit("green")).otherwise(F.lit("red")))
            .otherwise(as_col(current)))


def percent_change(open_, close) -> Column:
    """Change from open to close in percent, 0 for a zero open."""
    open_, close = as_col(open_), as_col(close)
    return F.when(open_ != 0, (close - open_) / open_ * 100).otherwise(F.lit(0.0))
