"""Table jobs: retention, compaction, roll-up, incremental import, gap backfill and populate.

Every job handles all symbols in one plan. Only lists of days, bounded by the calendar, and the names of small files reach
the driver.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import ms_to_timestamp
from ..operators.candles import detect_gaps, first_available, high_watermarks, resample
from ..operators.lookup import rows_in_ranges
from ..operators.merge import only_new, priority_merge
from ..operators.normalize import candle_points, synthetic_ticks, tradable_symbols
from ..operators.sizing import small_side
from ..schemas import (CACHE_RETENTION_MS, DAY_MS, GAP_LOOKBACK_MS, HISTORY_TRIM_MS, HISTORY_TTL_MS, HOUR_MS,
                       MIN_GAP_MS, MIN_INPUT_FILES, MINUTE_MS, POPULATE_DAYS,
                       STORE_RETENTION_MS, TARGET_FILE_BYTES)
from ..sources.lake import (SORT_ORDER, append_sorted, child_names, data_files, delete_path, drop_days, move_file,
                            overwrite_days, read_text, table_exists, with_day, write_text)
from .serving import in_range, stored_minutes

HOURLY_SORT = ("symbol", "open_time")
#: Below this share of the target size a file is merged, beyond that multiple it is split.
SMALL, LARGE = 0.75, 1.8
#: Groups of one write, which bounds the list of files that is broadcast.
GROUPS_AT_ONCE = 2_000
#: Folders of new files on their way into the table; readers skip names with an underscore.
ASIDE, MANIFEST = "_compact-", "manifest.json"


def expired(cutoff_ms: int) -> Column:
    """Closed one-minute rows that start before the cutoff."""
    return (F.col("interval") == "1m") & F.col("is_closed") & (F.col("kline_start") < cutoff_ms)


def retention_cutoff(now_ms: int, days: int) -> int:
    return now_ms - max(days, 1) * DAY_MS


def retained(klines: DataFrame, now_ms: int, days: int) -> DataFrame:
    """The table as it is after the retention delete."""
    return klines.filter(~expired(retention_cutoff(now_ms, days)))


def apply_retention(spark: SparkSession, path: str, now_ms: int, days: int) -> dict[str, int]:
    """Delete closed one-minute klines older than ``days`` from a day-partitioned table.

    Only days up to the cutoff are scanned. Days left empty are dropped as folders, days that keep
    some rows are rewritten, the others are not touched.
    """
    cutoff = retention_cutoff(now_ms, days)
    old = spark.read.parquet(path).filter(F.col("dt") <= F.to_date(ms_to_timestamp(F.lit(cutoff))))
    gone = F.coalesce(expired(cutoff), F.lit(False))
    days_seen = old.groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count_if(gone).alias("gone"), F.count(F.lit(1)).alias("n")).collect()
    partly = [r["dt"] for r in days_seen if 0 < r["gone"] < r["n"]]
    wholly = [r["dt"] for r in days_seen if r["gone"] == r["n"]]
    if partly:
        keep = old.filter(F.col("dt").cast("string").isin(partly) & ~gone)
        overwrite_days(keep.repartitionByRange("dt", *SORT_ORDER["kline"])
                       .sortWithinPartitions("dt", *SORT_ORDER["kline"]), path)
    drop_days(spark, path, wholly)
    return {"days_rewritten": len(partly), "days_dropped": len(wholly),
            "rows_deleted": sum(r["gone"] for r in days_seen)}


def _by_interval(limits: dict[str, int]) -> Column:
    pairs = [F.lit(x) for label, ms in limits.items() for x in (label, ms)]
    return F.try_element_at(F.create_map(*pairs), F.col("interval"))


def within_retention(klines: DataFrame, now_ms: int, cache: bool = False) -> DataFrame:
    """Rows younger than their interval's retention; other intervals stay."""
    keep_ms = _by_interval(CACHE_RETENTION_MS if cache else STORE_RETENTION_MS)
    return klines.filter(keep_ms.isNull() | (F.col("kline_start") >= F.lit(now_ms) - keep_ms))


def trim_history(ticks: DataFrame, keep_ms: int = HISTORY_TRIM_MS) -> DataFrame:
    """Ticks of the last ``keep_ms`` before each symbol's newest one.

    The cutoffs are one row per symbol, so the ticks need no shuffle while those fit a broadcast.
    """
    cutoff = ticks.groupBy("symbol").agg((F.max("event_time") - keep_ms).alias("_cutoff"))
    return ticks.join(small_side(cutoff), "symbol").filter(F.col("event_time") > F.col("_cutoff")).drop("_cutoff")


def unexpired(rows: DataFrame, now_ms: int, keep_ms: int = HISTORY_TTL_MS, time: str = "event_time") -> DataFrame:
    """Rows of the symbols last written less than ``keep_ms`` ago; a symbol expires as a whole."""
    written = rows.filter(F.col(time) > now_ms - keep_ms).select("symbol").distinct()
    return rows.join(small_side(written), "symbol", "left_semi")


def pack_files(sizes: dict[str, int], target_bytes: int) -> list[list[str]]:
    """Groups of files of at most the target together, first fit in decreasing size."""
    groups, room = [], []
    for path, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = next((k for k, left in enumerate(room) if size <= left), None)
        if at is None:
            groups.append([])
            room.append(target_bytes)
            at = len(groups) - 1
        groups[at].append(path)
        room[at] -= size
    return groups


def compaction_plan(spark: SparkSession, path: str, target_bytes: int = TARGET_FILE_BYTES,
                    min_files: int = MIN_INPUT_FILES) -> tuple[dict[str, list[list[str]]], dict[str, dict[str, int]]]:
    """By day: groups of small files to merge, and files beyond the largest size to split (with their bytes).

    Files near the target stay as they are. A day has work if it holds ``min_files`` small files or one that is too large; a file left
    alone in its group stays too. Only names and sizes of the files in question reach the driver.
    """
    size = F.when(F.col("bytes") < SMALL * target_bytes, "small").when(F.col("bytes") > LARGE * target_bytes, "large")
    files = data_files(spark, path).withColumn("kind", size).filter("kind IS NOT NULL")
    few = W.partitionBy("dt", "kind")
    files = files.filter(F.col("kind") == "large").unionByName(
        files.filter(F.col("kind") == "small").withColumn("n", F.count(F.lit(1)).over(few)).filter(F.col("n") >= min_files).drop("n"))
    small, large = {}, {}
    for r in files.select(F.col("dt").cast("string").alias("dt"), "path", "bytes", "kind").collect():
        (small if r["kind"] == "small" else large).setdefault(r["dt"], {})[r["path"]] = r["bytes"]
    groups = {day: [g for g in pack_files(sizes, target_bytes) if len(g) > 1] for day, sizes in small.items()}
    return {day: g for day, g in groups.items() if g}, large


def compact(spark: SparkSession, path: str, sort: tuple[str, ...] = SORT_ORDER["kline"],
            target_bytes: int = TARGET_FILE_BYTES, min_files: int = MIN_INPUT_FILES) -> int:
    """Merge small files of a day into files near the target size and split files far beyond it; returns the days done.

    Other files are neither read nor replaced. The new files are written aside; a manifest then names what goes and what comes, so a
    run that breaks off in the exchange is completed by the next one, and one that breaks off before leaves no trace.
    """
    finish_compaction(spark, path)
    groups, large = compaction_plan(spark, path, target_bytes, min_files)
    if not groups and not large:
        return 0
    aside = f"{path}/{ASIDE}{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    columns = [c for c in schema.names if c != "dt"]

    def rows_of(files: list[str]) -> DataFrame:
        return spark.read.schema(schema).option("basePath", path).parquet(*files)

    merged = [(day, g) for day, packed in sorted(groups.items()) for g in packed]
    for at in range(0, len(merged), GROUPS_AT_ONCE):
        # One task and one file a group: the list of files is bounded, so it may be broadcast.
        some = list(enumerate(merged[at:at + GROUPS_AT_ONCE], at))
        place = spark.createDataFrame([(f, k) for k, (_, g) in some for f in g], "_file string, _group int")
        rows = rows_of([f for _, (_, g) in some for f in g]).withColumn("_file", F.col("_metadata.file_path"))
        (rows.join(F.broadcast(place), "_file").repartition(len(some), "_group").sortWithinPartitions("_group", *sort)
         .select(F.concat(F.lit("dt="), F.col("dt").cast("string"), F.lit("/g"), F.col("_group")).alias("_to"), *columns)
         .write.mode("append").partitionBy("_to").option("compression", "zstd").parquet(aside))
    if large:
        files = sum(-(-size // target_bytes) for sizes in large.values() for size in sizes.values())
        (rows_of([f for sizes in large.values() for f in sizes]).repartitionByRange(files, "dt", *sort).sortWithinPartitions("dt", *sort)
         .select(F.concat(F.lit("dt="), F.col("dt").cast("string"), F.lit("/split")).alias("_to"), *columns)
         .write.mode("append").partitionBy("_to").option("compression", "zstd").parquet(aside))
    old = [f for _, g in merged for f in g] + [f for sizes in large.values() for f in sizes]
    write_text(spark, f"{aside}/{MANIFEST}", json.dumps(old))
    finish_compaction(spark, path)
    return len(groups.keys() | large.keys())


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Complete exchanges that have a manifest, forget the others. Doing it twice does no harm."""
    for folder in child_names(spark, path):
        if not folder.startswith(ASIDE):
            continue
        names = child_names(spark, f"{path}/{folder}")
        if MANIFEST in names:
            for target in names:
                if target.startswith("_to="):
                    day = unquote(target[4:]).split("/")[0]
                    for part in child_names(spark, f"{path}/{folder}/{target}"):
                        if part.endswith(".parquet"):
                            move_file(spark, f"{path}/{folder}/{target}/{part}", f"{path}/{day}/c{folder[len(ASIDE):]}-{part}")
            for old in json.loads(read_text(spark, f"{path}/{folder}/{MANIFEST}")):
                delete_path(spark, old)
        delete_path(spark, f"{path}/{folder}")


def build_hourly(spark: SparkSession, klines: DataFrame, path: str, since_ms: int | None = None) -> None:
    """Roll the stored minutes up to hours and upsert them into the hourly table.

    ``since_ms`` (rounded up to a whole hour) keeps hours whose minutes were partly deleted as they
    are stored. Only the days that receive rows are rewritten.
    """
    minutes = stored_minutes(klines)
    if since_ms is not None:
        minutes = in_range(minutes, -(-since_ms // HOUR_MS) * HOUR_MS)
    hourly = resample(minutes, HOUR_MS)
    if not table_exists(spark, path):
        append_sorted(hourly, path, "open_time", HOURLY_SORT)
        return
    fresh = with_day(hourly, "open_time")
    touched = small_side(fresh.select("dt").distinct())
    stored = spark.read.parquet(path).join(touched, "dt", "left_semi").select(*fresh.columns)
    merged = priority_merge(stored, fresh)
    overwrite_days(merged.repartitionByRange("dt", *HOURLY_SORT).sortWithinPartitions("dt", *HOURLY_SORT), path)


def import_rows(symbols: DataFrame, source: DataFrame, target: DataFrame | None, now_ms: int,
                full: bool = False) -> DataFrame:
    """Source klines to append: per symbol from its start up to the last whole minute.

    The start is the table's high watermark, or for a full import and for a symbol not yet stored
    the first available time. Rows already stored are left out, so a rerun adds nothing; only the
    days that the new rows touch are read for that.
    """
    end = now_ms - now_ms % MINUTE_MS
    if full or target is None:
        starts = first_available(symbols, source)
    else:
        starts = high_watermarks(symbols, target, unknown_ms=None)
    rows = (source.filter(F.col("kline_start") < end).join(small_side(starts), "symbol")
            .filter(F.col("start_ms").isNull() | (F.col("kline_start") >= F.col("start_ms"))).drop("start_ms"))
    keys = ["symbol", "interval", "kline_start"]
    if target is None:
        return rows.dropDuplicates(keys)
    span = rows.agg(F.min("kline_start").alias("lo"), F.max("kline_start").alias("hi")).first()
    stored = target if span["lo"] is None else in_range(target, span["lo"], span["hi"] + 1, "kline_start")
    return only_new(rows, stored, keys)


def import_klines(spark: SparkSession, symbols: DataFrame, source: DataFrame, path: str, now_ms: int,
                  full: bool = False) -> None:
    """Incremental (or full) historical import into the day-partitioned kline table."""
    target = spark.read.parquet(path) if table_exists(spark, path) else None
    rows = import_rows(symbols, source, target, now_ms, full)
    append_sorted(rows, path, "kline_start", SORT_ORDER["kline"])


def backfill_points(ticks: DataFrame, history: DataFrame, now_ms: int,
                    look_back_ms: int = GAP_LOOKBACK_MS, min_gap_ms: int = MIN_GAP_MS) -> DataFrame:
    """Synthetic ticks for every gap of the look-back window, from stored one-minute klines."""
    gaps = detect_gaps(ticks, min_gap_ms, now_ms - look_back_ms)
    minutes = history.filter((F.col("interval") == "1m") & (F.col("kline_start") >= now_ms - look_back_ms))
    found = rows_in_ranges(gaps, minutes, "gap_start", "gap_end", "kline_start")
    # Neighbouring gaps can meet at a border minute; a point is written once.
    return synthetic_ticks(found.drop("gap_start", "gap_end").dropDuplicates(["symbol", "kline_start"]))


def populate_points(symbols: DataFrame, source: DataFrame, now_ms: int, days: int = POPULATE_DAYS,
                    first: int | None = None) -> DataFrame:
    """Candle points of the last ``days`` for the tradable symbols, or the ``first`` ones of them."""
    wanted = tradable_symbols(symbols, first=first)
    recent = source.filter((F.col("kline_start") >= now_ms - days * DAY_MS) & (F.col("kline_start") < now_ms))
    return candle_points(recent.join(small_side(wanted), "symbol", "left_semi"))
