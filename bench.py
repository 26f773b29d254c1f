"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores. Each query runs
once to warm up, then is timed; results go to the noop sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import Observation, functions as F

from tickloom.catalog import load_all
from tickloom.operators.candles import resample
from tickloom.operators.merge import priority_merge
from tickloom.operators.normalize import typed_candles
from tickloom.schemas import DAY_MS, HOUR_MS, MINUTE_MS
from tickloom.session import build_session, fresh_dir
from tickloom.sources import tables as tb

# name -> driver table its input rows come from
HEADLINE = {
    "supplier_candles_1d": "lineitem",
    "supplier_candles_1w": "lineitem",
    "order_candles_1w": "orders",
    "ohlcv_1h": "events",
    "resample_1m_to_5m": "events",
    "resample_1m_to_1h": "events",
    "resample_1m_to_1d": "events",
    "priority_merge": "events",
    "ema_first_seed": "events",
    "rsi14": "events",
    "sma": "events",
    "price_gaps": "events",
    "gap_filled_1h": "events",
    "live_enriched_behind": "events",
    "gap_history_rows": "events",
    "last_before_cursor": "events",
    "recent_klines_4h": "events",
    "historical_klines_1d": "events",
    "throttled_ticks": "events",
    "depth_curve": "lineitem",
    "validated_symbols": "events",
    "validated_intervals": "events",
    "rfc3339_times": "events",
    "typed_candles": "events",
    "normalized_klines": "events",
    "routed_events": "events",
    "incremental_import": "events",
    "streamed_throttle": "events",
    "streamed_idle_minutes": "events",
    "streamed_block_indicators": "events",
    "streamed_topic_log": "events",
    "avro_records": "events",
    "paged_klines_4h": "events",
    "watchlist_page": "events",
}

CEILINGS = {"stored_resample_5m": 0.5, "stored_resample_1h": 2.0, "stored_resample_1d": 0.1,
            "stored_merge_partial": 0.5, "stored_merge_full": 0.3, "stored_typed_candles": 0.2,
            "validated_symbols_10k": 0.1, "validated_intervals_10k": 0.1, "rfc3339_times_10k": 0.2}
SMALL, SMALL_CASES = "sf0.01", ("validated_symbols", "validated_intervals", "rfc3339_times")


def stored_cases(spark, sf_dir: str):
    """The baseline's own cases: candles already stored, only the operator is timed."""
    path = fresh_dir(spark, "bench-candles")
    tb.candles(spark, sf_dir, MINUTE_MS).write.parquet(path)
    candles = spark.read.parquet(path)
    half = candles.agg(F.percentile_approx("open_time", 0.5)).first()[0]
    later = candles.filter(F.col("open_time") >= half)
    return {"stored_resample_5m": lambda: resample(candles, 5 * MINUTE_MS),
            "stored_resample_1h": lambda: resample(candles, HOUR_MS),
            "stored_resample_1d": lambda: resample(candles, DAY_MS),
            "stored_merge_partial": lambda: priority_merge(candles, later),
            "stored_merge_full": lambda: priority_merge(candles, candles),
            "stored_typed_candles": lambda: typed_candles(candles)}, candles.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("tickloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog, seconds, detail = load_all(), {}, {}
    inputs = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(HEADLINE.values())}
    # The ceilings of the validations are for 10,000 rows, which the next smaller tables have.
    small_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), SMALL)
    small = {f"{name}_10k": name for name in SMALL_CASES} if os.path.isdir(small_dir) else {}

    stored, n_stored = stored_cases(spark, sf_dir)

    def run(name: str) -> tuple[float, int]:
        start, rows = time.perf_counter(), Observation()
        if name in small:
            built = catalog[small[name]].run(spark, small_dir)
        else:
            built = stored[name]() if name in stored else catalog[name].run(spark, sf_dir)
        df = built.observe(rows, F.count(F.lit(1)).alias("n"))
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start, rows.get["n"]

    only = sys.argv[1:]
    for name in [*HEADLINE, *stored, *small]:
        if only and name not in only:
            continue
        run(name)
        took, rows_out = run(name)
        seconds[name] = round(took, 3)
        rows_in = inputs[HEADLINE[name]] if name in HEADLINE else n_stored if name in stored else rows_out
        detail[name] = {"rows_in": rows_in, "rows_out": rows_out}
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "rows": detail,
                      "baseline_ceiling_sec": {k: v for k, v in CEILINGS.items() if k in seconds},
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
