"""Physical plans: what must hold at scale whatever the data."""

from __future__ import annotations

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

from tickloom.catalog import load_all
from tickloom.operators import candles as C, indicators as I, merge as M
from tickloom.schemas import HOUR_MS
from tickloom.sources import tables as tb

SF_DIR = "/root/testdata/sf0.001"
# Queries that run jobs or streams while being built.
EAGER = {"retention_delete", "compacted_table", "incremental_import", "full_import", "hourly_table", "day_table",
         "declared_schema_read", "throttled_ticks", "ingest_accounting", "watchlist_page"}
CATALOG = {n: q for n, q in load_all().items() if n not in EAGER and not n.startswith("streamed_")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_no_cross_join_no_single_partition_window_no_row_udf(spark, name):
    plan = plan_of(CATALOG[name].run(spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not line.rstrip().endswith("[], [")
            assert "windowspecdefinition(symbol" in line or "windowspecdefinition(l_suppkey" in line


def test_resample_hashes_and_aggregates_before_the_shuffle(spark):
    plan = plan_of(C.resample(tb.candles(spark, SF_DIR, HOUR_MS), 24 * HOUR_MS))
    assert plan.count("partial_min_by") == 2 and "SortAggregate" not in plan
    assert "SortAggregate" not in plan_of(C.candles_from_ticks(tb.ticks_big(spark, SF_DIR), HOUR_MS))


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(C.candles_from_ticks(tb.ticks_many(spark, SF_DIR), HOUR_MS).select("symbol", "close"))
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>", plan)


def test_pandas_functions_run_where_the_package_is_not_installed(tmp_path):
    script = """
import sys
sys.path.insert(0, {repo!r})
from tickloom.session import build_session
from tickloom.catalog import load_all
spark = build_session(master="local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
print("rows", load_all()["ema_first_seed"].run(spark, {sf!r}).count(), load_all()["ingest_accounting"].run(spark, {sf!r}).count())
""".format(repo=str(Path(__file__).resolve().parents[1]), sf=SF_DIR)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert re.search(r"rows [1-9]\d* 3", done.stdout), done.stderr[-2000:]


def test_last_n_is_limited_before_the_shuffle(spark):
    plan = plan_of(M.newest_n(tb.candles(spark, SF_DIR, HOUR_MS), 5))
    assert plan.count("WindowGroupLimit") >= 1


def test_row_frames_are_partitioned_by_block(spark):
    for df in (I.sma(tb.candles(spark, SF_DIR, HOUR_MS), (20,), HOUR_MS), I.mfi(tb.candles(spark, SF_DIR, HOUR_MS), 14, HOUR_MS)):
        frames = [ln for ln in plan_of(df).splitlines() if re.search(r"\bWindow \[", ln) and re.search(r"avg\(|_in#|sum\(", ln)]
        assert frames and all("_block" in ln for ln in frames)
