"""Block-partitioned operators against plain sequential code, for several block lengths and shapes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import blocks as K, indicators as I
from tickloom.operators.candles import as_of
from tickloom.operators.throttle import throttle

from .conftest import as_dicts, candle_frame


def series(seed, n, sparse):
    """Prices at irregular steps; ``sparse`` leaves gaps far longer than a block."""
    rng, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += 60_000 * (rng.choice([1, 1, 2, 700]) if sparse else 1)
        p = round(rng.uniform(50, 60), 2)
        out.append((t, p, p + 1, p - 1, round(rng.uniform(50, 60), 2), float(rng.randint(0, 9))))
    return out


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("block", [60_000, 7 * 60_000, 10 ** 9])
def test_halo_gives_exact_trailing_frames(spark, sparse, block):
    rows = series(1, 300, sparse)
    n = 5
    df = candle_frame(spark, rows).select("symbol", "open_time", "close")
    out = K.trailing(df, n, block, ["open_time"], {
        "total": lambda w: F.sum("close").over(w.rowsBetween(-n, 0)), "prev": lambda w: F.lag("close", n).over(w)})
    closes = [r[4] for r in rows]
    got = sorted(as_dicts(out), key=lambda r: r["open_time"])
    assert len(got) == len(rows)
    for i, r in enumerate(got):
        assert r["total"] == pytest.approx(sum(closes[max(0, i - n):i + 1]))
        assert r["prev"] == (closes[i - n] if i >= n else None)
    back = sorted(as_dicts(K.trailing(df, 1, block, ["open_time"], {"next": lambda w: F.lag("close").over(w)}, reverse=True)),
                  key=lambda r: r["open_time"])
    assert [r["next"] for r in back] == closes[1:] + [None]


@pytest.mark.parametrize("block", [60_000, 10 ** 9])
def test_row_index_and_carry(spark, block):
    rows = series(2, 100, True)
    df = candle_frame(spark, rows).select("symbol", "open_time", F.when(F.col("volume") > 6, F.col("close")).alias("v"))
    out = sorted(as_dicts(K.with_carry(K.with_row_index(df, block, ["open_time"]), F.col("v"), "last", block, ["open_time"])),
                 key=lambda r: r["open_time"])
    assert [r["row_index"] for r in out] == list(range(1, 101)) and out[0]["row_count"] == 100
    last = None
    for r, row in zip(out, rows):
        last = row[4] if row[5] > 6 else last
        assert r["last"] == last


def ema_reference(xs, period, seed):
    k, out = 2 / (period + 1), [None] * len(xs)
    start = 1 if seed == "first" else period
    if len(xs) < start:
        return out
    e = sum(xs[:start]) / start
    out[start - 1] = e
    for i in range(start, len(xs)):
        e = xs[i] * k + e * (1 - k)
        out[i] = e
    return out


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("seed", ["first", "sma"])
def test_ema_equals_the_sequential_recursion(spark, monkeypatch, sparse, seed):
    rows = series(3, 1500, sparse)
    both = candle_frame(spark, rows).unionByName(candle_frame(spark, rows[:40], symbol="BUSDT"))
    for steps in (1, 13, 512):
        monkeypatch.setattr(I, "BLOCK_STEPS", steps)
        got = as_dicts(I.ema(both, (1, 2, 12, 50), 60_000, seed))
        for symbol, source in (("AUSDT", rows), ("BUSDT", rows[:40])):
            mine = sorted((r for r in got if r["symbol"] == symbol), key=lambda r: r["open_time"])
            for period in (1, 2, 12, 50):
                want = ema_reference([r[4] for r in source], period, seed)
                assert [r[f"ema{period}"] for r in mine] == [x if x is None else pytest.approx(x, rel=1e-11) for x in want]


def rsi_reference(closes, n):
    moves = [b - a for a, b in zip(closes, closes[1:])]
    gain, loss = [max(m, 0) for m in moves], [max(-m, 0) for m in moves]
    out = [None] * min(len(closes), n)
    if len(moves) < n:
        return out
    g, l = sum(gain[:n]) / n, sum(loss[:n]) / n
    for i in range(n - 1, len(moves)):
        if i >= n:
            g, l = (g * (n - 1) + gain[i]) / n, (l * (n - 1) + loss[i]) / n
        out.append(100.0 if l == 0 else 100 - 100 / (1 + g / l))
    return out


def mfi_reference(rows, n):
    tp = [(r[2] + r[3] + r[4]) / 3 for r in rows]
    out = [None] * min(len(rows), n)
    for i in range(n, len(rows)):
        pos = neg = 0.0
        for j in range(i - n + 1, i + 1):
            if tp[j] >= tp[j - 1]:
                pos += tp[j] * rows[j][5]
            else:
                neg += tp[j] * rows[j][5]
        out.append(100.0 if neg == 0 else 100 - 100 / (1 + pos / neg))
    return out


@pytest.mark.parametrize("sparse", [False, True])
def test_rsi_and_mfi(spark, monkeypatch, sparse):
    monkeypatch.setattr(I, "BLOCK_STEPS", 16)
    rows = series(4, 400, sparse)
    df = candle_frame(spark, rows)
    for fn, name, want in ((I.rsi, "rsi", rsi_reference([r[4] for r in rows], 14)), (I.mfi, "mfi", mfi_reference(rows, 14))):
        got = {r["open_time"]: r[name] for r in as_dicts(fn(df, 14, 60_000))}
        expected = {r[0]: x for r, x in zip(rows, want) if x is not None}
        assert got == {t: pytest.approx(x, rel=1e-9) for t, x in expected.items()}


def test_rsi_without_losses_is_100(spark):
    rows = [(i * 60_000, 1.0, 1.0, 1.0, float(i), 1.0) for i in range(20)]
    assert {r["rsi"] for r in as_dicts(I.rsi(candle_frame(spark, rows), 14, 60_000))} == {100.0}
    assert I.rsi(candle_frame(spark, rows[:14]), 14, 60_000).count() == 0


def throttle_reference(ticks, beat):
    price = sent = None
    out = {}
    for t, seq, p in ticks:
        changed, due = p != price, sent is None or t - sent >= beat
        out[seq] = "change" if changed else "heartbeat" if due else "skipped"
        if changed or due:
            price, sent = p, t
    return out


@pytest.mark.parametrize("flat", [0.0, 0.9, 1.0])
def test_throttle_equals_the_greedy_walk(spark, flat):
    rng, t, p, ticks = random.Random(int(flat * 10)), 0, 1.0, []
    for seq in range(600):
        t += rng.choice([0, 1, 400, 900, 2600, 20_000])
        p = p if rng.random() < flat else p + 1
        ticks.append((t, seq, p))
    df = spark.createDataFrame([("A", t, s, p) for t, s, p in ticks], "symbol string, event_time long, seq long, price double")
    want = throttle_reference(ticks, 5000)
    for block in (1000, 5000, 60_000, None):
        got = {r["seq"]: r["reason"] for r in as_dicts(throttle(df, 5000, block))}
        assert got == want, block


def test_fit_block(spark):
    df = spark.createDataFrame([("A", t * 1000) for t in range(200)], "symbol string, event_time long")
    assert K.fit_block(df, "event_time", (1000, 10_000, 100_000), 10) == 10_000
    assert K.fit_block(df, "event_time", (10_000, 100_000), 5) == 10_000


def test_as_of_takes_the_value_at_or_before(spark):
    probes = spark.createDataFrame([("A", t) for t in (5, 10, 15, 99_999)], "symbol string, open_time long")
    values = spark.createDataFrame([("A", 10, 1.0), ("A", 20, 2.0)], "symbol string, open_time long, close double")
    got = {r["open_time"]: r["close"] for r in as_dicts(as_of(probes, values, "close", 8))}
    assert got == {5: None, 10: 1.0, 15: 1.0, 99_999: 2.0}


def test_smoothing_of_many_rows_in_one_step_stays_finite(spark):
    rows = spark.range(5000).select(F.lit("A").alias("symbol"), F.lit(0).cast("long").alias("open_time"), F.lit(7.0).alias("close"))
    out = I.ema(rows, [12, 26], 60_000)
    low, high, n = out.agg(F.min("ema12"), F.max("ema26"), F.count("ema12")).first()
    assert n == 5000 and abs(low - 7.0) < 1e-9 and abs(high - 7.0) < 1e-9
