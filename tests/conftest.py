from __future__ import annotations

import pytest

from tickloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tickloom-tests", "local[8]", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false", spark__driver__memory="6g",
                            spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def candle_frame(spark, rows, extra="", symbol="AUSDT"):
    """Candles of one symbol from (open_time, open, high, low, close, volume) tuples."""
    schema = "symbol string, open_time long, open double, high double, low double, close double, volume double"
    return spark.createDataFrame([(symbol, *r) for r in rows], schema + extra)
