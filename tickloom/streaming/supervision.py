"""Several streaming queries as one application: a listener's log of their progress, and one fate for all."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "name string, batch bigint, rows_in bigint, rows_late bigint, state_rows bigint, watermark string"
OBSERVED = "name string, batch bigint, metric string, value double"


class SupervisedFailure(RuntimeError):
    """A query of the application failed; the others were stopped."""

    def __init__(self, name: str, cause: str):
        super().__init__(f"query {name} failed: {cause}")
        self.name, self.cause = name, cause


class ProgressLog(StreamingQueryListener):
    """One row per micro-batch of the listed runs, with late rows and observed metrics, and how each run ended."""

    def __init__(self):
        self.names: dict[str, str] = {}
        self.progress: dict[tuple[str, int], tuple] = {}
        self.metrics: dict[tuple[str, int, str], float] = {}
        self.ended: dict[str, str | None] = {}
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.news:
            run = str(p.runId)
            stateful = p.stateOperators
            self.progress[run, p.batchId] = (p.numInputRows, sum(s.numRowsDroppedByWatermark for s in stateful),
                                             sum(s.numRowsTotal for s in stateful), (p.eventTime or {}).get("watermark"))
            for group, row in (p.observedMetrics or {}).items():
                for field, value in row.asDict().items():
                    if value is not None:
                        self.metrics[run, p.batchId, f"{group}.{field}"] = float(value)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended[str(event.runId)] = event.exception
            self.news.notify_all()

    def table(self, spark: SparkSession) -> DataFrame:
        """The micro-batches of the named runs; later progress of one batch replaces earlier."""
        rows = [(self.names[run], batch, *values) for (run, batch), values in sorted(self.progress.items()) if run in self.names]
        return spark.createDataFrame(rows, PROGRESS)

    def observations(self, spark: SparkSession) -> DataFrame:
        rows = [(self.names[run], batch, metric, value) for (run, batch, metric), value in sorted(self.metrics.items()) if run in self.names]
        return spark.createDataFrame(rows, OBSERVED)


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Name aggregates of the rows that pass here; the listener gets them with every micro-batch."""
    return df.observe(name, *(value.alias(field) for field, value in metrics.items()))


def run_supervised(spark: SparkSession, starts: Mapping[str, Callable[[], StreamingQuery]], settle_s: float = 60.0) -> ProgressLog:
    """Start all queries and wait until all have ended. The first failure stops the others and is passed on with its cause.

    The end of a run reaches the listener after its last progress, so the log is complete when this returns.
    """
    log, queries = ProgressLog(), {}
    spark.streams.addListener(log)
    failed = None
    try:
        for name, start in starts.items():
            queries[name] = start()
            with log.news:
                log.names[str(queries[name].runId)] = name
        while failed is None and any(q.isActive for q in queries.values()):
            with log.news:
                log.news.wait(0.2)
            failed = next((name for name, q in queries.items() if not q.isActive and q.exception()), None)
        failed = failed or next((name for name, q in queries.items() if q.exception()), None)
    finally:
        for q in queries.values():
            q.stop()
        with log.news:
            log.news.wait_for(lambda: all(str(q.runId) in log.ended for q in queries.values()), settle_s)
        spark.streams.removeListener(log)
    if failed:
        raise SupervisedFailure(failed, str(queries[failed].exception()))
    return log
