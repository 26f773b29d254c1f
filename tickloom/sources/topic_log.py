"""A partitioned message log as a streaming source: offsets, start at latest or earliest, bounded micro-batches.

A log is a folder: ``partition=P/segment=S`` holds the messages whose offsets lie in the S-th run of ``segment_rows`` offsets, and every
append ends with a marker that names the end offset of each partition. Readers trust the newest markers, so messages of an
unfinished append are never seen. Segments may be removed (retention); reading over the gap is no error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.blocks import with_row_index
from ..schemas import HOUR_MS
from .lake import delete_path, write_text

SCHEMA = "partition int, offset bigint, key string, value binary, timestamp bigint"
MARKERS = "_ends"
PARTITIONS, SEGMENT_ROWS = 4, 100_000


def append_log(messages: DataFrame, path: str, order: list[str], partitions: int = PARTITIONS, segment_rows: int = SEGMENT_ROWS,
               block_ms: int = HOUR_MS) -> dict[int, int]:
    """Append (key, value, timestamp, ...) rows; a key's messages go to one partition in ``order`` (whose first column is in ms).

    Offsets are dense within a partition and follow those already there. The number of partitions and the segment size
    of a log never change. Returns the new end offsets.
    """
    spark = messages.sparkSession
    ends, sizes = end_offsets(path)
    if sizes and sizes != (partitions, segment_rows):
        raise ValueError(f"the log has {sizes[0]} partitions and segments of {sizes[1]} offsets")
    base = F.coalesce(F.create_map(*[F.lit(x) for p in ends for x in (p, ends[p])])[F.col("partition")], F.lit(0)) if ends else F.lit(0)
    dealt = messages.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    numbered = with_row_index(dealt, block_ms, order, key="partition").withColumn("offset", F.col("row_index") - 1 + base)
    rows = numbered.select("partition", (F.col("offset") / segment_rows).cast("long").alias("segment"), "offset", "key", "value", "timestamp")
    (rows.repartition("partition", "segment").sortWithinPartitions("partition", "segment", "offset")
     .write.mode("append").partitionBy("partition", "segment").parquet(path))
    # Counted from the input, one row a partition.
    grown = {r["partition"]: r["count"] for r in dealt.groupBy("partition").count().collect()}
    ends = {p: ends.get(p, 0) + grown.get(p, 0) for p in range(partitions)}
    write_text(spark, f"{path}/{MARKERS}/{uuid.uuid4().hex}.json", json.dumps({"ends": ends, "segment_rows": segment_rows}))
    return ends


def drop_segments(spark: SparkSession, path: str, before: dict[int, int]) -> None:
    """Retention: remove the segments of each partition that lie wholly before an offset."""
    _, sizes = end_offsets(path)
    for partition, offset in before.items():
        for segment in _segments(path).get(partition, []):
            if sizes and (segment + 1) * sizes[1] <= offset:
                delete_path(spark, f"{path}/partition={partition}/segment={segment}")


def _open(path: str):
    """File system and path of a location, without Spark: planning and reading run in Python workers."""
    from pyarrow import fs
    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])


def _listed(path: str, recursive: bool = False):
    from pyarrow import fs
    store, root = _open(path)
    return store, store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=recursive))


def end_offsets(path: str) -> tuple[dict[int, int], tuple[int, int] | None]:
    """End offset of every partition, and the log's (partitions, segment size), from the markers; nothing for a new log."""
    store, files = _listed(f"{path}/{MARKERS}")
    ends, rows = {}, None
    for f in files:
        if f.base_name.endswith(".json") and not f.base_name.startswith("."):
            marker = json.loads(store.open_input_stream(f.path).read())
            rows = marker["segment_rows"]
            for p, end in marker["ends"].items():
                ends[int(p)] = max(ends.get(int(p), 0), end)
    return ends, (len(ends), rows) if rows else None


def _segments(path: str) -> dict[int, list[int]]:
    found = {}
    for f in _listed(path)[1]:
        if f.base_name.startswith("partition="):
            inside = _listed(f"{path}/{f.base_name}")[1]
            found[int(f.base_name[10:])] = sorted(int(s.base_name[8:]) for s in inside if s.base_name.startswith("segment="))
    return found


class Stretch(InputPartition):
    """Offsets [start, end) of one segment of a partition."""

    def __init__(self, partition: int, segment: int, start: int, end: int):
        self.partition, self.segment, self.start, self.end = partition, segment, start, end


class TopicLogReader(DataSourceStreamReader):
    """Plans stretches of offsets; a micro-batch takes at most ``maxOffsetsPerTrigger`` in all, an even share of each partition.

    Spark does not tell a Python source where it stands after a restart, so the end of each planned micro-batch is written to the folder of
    the option ``progress`` before Spark sees it; keep it beside the checkpoint. A crash in between makes the next micro-batch longer, never wrong: what is read
    is always the stretch from Spark's own committed offsets.
    """

    def __init__(self, options: dict[str, str]):
        options = {name.lower(): value for name, value in options.items()}
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("maxoffsetspertrigger", 500_000))
        self.start = options.get("startingoffsets", "latest")
        self.progress = options.get("progress")
        if self.start not in ("latest", "earliest"):
            raise ValueError("startingOffsets is latest or earliest")
        self.current: dict[int, int] | None = None

    def _read_progress(self) -> dict[int, int] | None:
        if not self.progress:
            return None
        store, files = _listed(self.progress)
        names = sorted(f.path for f in files if f.base_name.endswith(".json"))
        return {int(p): n for p, n in json.loads(store.open_input_stream(names[-1]).read()).items()} if names else None

    def _write_progress(self, number: int) -> None:
        if self.progress:
            store, root = _open(self.progress)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/.draft") as out:
                out.write(json.dumps(self.current).encode())
            store.move(f"{root}/.draft", f"{root}/{number:020d}.json")

    def initialOffset(self) -> dict:
        ends, sizes = end_offsets(self.path)
        if self.start == "latest" or not sizes:
            first = ends
        else:
            held = _segments(self.path)
            first = {p: min(end, held[p][0] * sizes[1]) if held.get(p) else end for p, end in ends.items()}
        return {str(p): n for p, n in first.items()}

    def latestOffset(self) -> dict:
        if self.current is None:
            self.current = self._read_progress()
        if self.current is None:
            self.current = {int(p): n for p, n in self.initialOffset().items()}
            self._write_progress(sum(self.current.values()))
        ends, _ = end_offsets(self.path)
        behind = {p: max(0, end - self.current.get(p, 0)) for p, end in ends.items()}
        left, moved = self.limit, dict(self.current)
        for rank, p in enumerate(sorted(behind, key=behind.get)):  # short partitions first: what they leave goes to the others
            step = min(behind[p], -(-left // (len(behind) - rank)))
            moved[p] = moved.get(p, 0) + step
            left -= step
        if moved != self.current:
            self.current = moved
            self._write_progress(sum(moved.values()))
        return {str(p): n for p, n in self.current.items()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        _, sizes = end_offsets(self.path)
        if any(end.get(p, 0) < at for p, at in start.items()):
            raise ValueError(f"offsets go back from {start} to {end}: {self.progress} does not belong to this query's checkpoint")
        out = []
        for p, stop in end.items():
            at = start.get(p, 0)
            while sizes and at < stop:
                segment = at // sizes[1]
                upto = min(stop, (segment + 1) * sizes[1])
                out.append(Stretch(int(p), segment, at, upto))
                at = upto
        return out

    def read(self, partition: Stretch) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        names = ["partition", "offset", "key", "value", "timestamp"]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
        store, files = _listed(f"{self.path}/partition={partition.partition}/segment={partition.segment}")
        inside = [("offset", ">=", partition.start), ("offset", "<", partition.end)]
        for f in sorted(f.path for f in files if f.base_name.endswith(".parquet")):
            table = pq.read_table(f, filesystem=store, columns=names[1:], filters=inside, partitioning=None)
            table = table.add_column(0, names[0], pa.array([partition.partition] * len(table), pa.int32()))
            yield from table.cast(pa.schema(list(zip(names, kinds)))).to_batches(max_chunksize=10_000)


class TopicLog(DataSource):
    """``spark.readStream.format("topic_log")`` with the options path, startingOffsets, maxOffsetsPerTrigger and progress."""

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TopicLogReader:
        return TopicLogReader(dict(self.options))


def read_log(spark: SparkSession, path: str, progress: str, starting: str = "latest", max_offsets: int = 500_000) -> DataFrame:
    """The log as a stream; ``progress`` belongs to one query, like its checkpoint."""
    spark.dataSource.register(TopicLog)
    return (spark.readStream.format("topic_log").option("path", path).option("progress", progress)
            .option("startingOffsets", starting).option("maxOffsetsPerTrigger", max_offsets).load())
