"""Per-batch metrics of streaming queries."""

from __future__ import annotations

import threading
from collections import deque
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

METRICS = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("wall_time", T.StringType()),
        T.StructField("watermark", T.StringType()),
        T.StructField("input_rows", T.LongType()),
        T.StructField("output_rows", T.LongType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("rows_per_second", T.DoubleType()),
        T.StructField("state_rows", T.LongType()),
        T.StructField("late_rows_dropped", T.LongType()),
    ]
)


class BatchMetrics(StreamingQueryListener):
    """One row per finished micro-batch, the latest ``keep`` of them, and totals over all.

    The totals of a query are three numbers, so a query that never ends costs no more memory.

    Use as a context manager to add the listener to a session and take it off again.
    """

    def __init__(self, spark: SparkSession, keep: int = 10_000, show: bool = False):
        self._spark = spark
        self._rows: deque[tuple] = deque(maxlen=keep)
        self._totals: dict[str, list[int]] = {}
        self._late: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}
        self._show = show

    def __enter__(self) -> BatchMetrics:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *exc) -> None:
        self._spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        latency = p.durationMs.get("triggerExecution", 0)
        row = (
            p.name or str(p.id),
            p.batchId,
            datetime.now(timezone.utc).isoformat(timespec="milliseconds"),
            p.eventTime.get("watermark"),
            p.numInputRows,
            p.sink.numOutputRows,
            latency,
            p.numInputRows * 1000.0 / latency if latency > 0 else 0.0,
            sum(s.numRowsTotal for s in p.stateOperators),
            sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
        )
        self._rows.append(row)
        totals = self._totals.setdefault(row[0], [0, 0, 0])
        for n, value in enumerate((p.numInputRows, p.sink.numOutputRows, row[-1])):
            totals[n] += value
        self._late[str(p.runId)] = self._late.get(str(p.runId), 0) + row[-1]
        if self._show:
            print(", ".join(f"{name}={value}" for name, value in zip(METRICS.names, row)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), threading.Event()).set()

    def wait_for_end(self, query, timeout_s: float | None = None) -> bool:
        """Events arrive a little after the query ends; wait for the last one."""
        return self._ended.setdefault(str(query.runId), threading.Event()).wait(timeout_s)

    def wait_for_all(self, timeout_s: float | None = None) -> bool:
        """As ``wait_for_end``, for every query seen so far."""
        return all(ended.wait(timeout_s) for ended in list(self._ended.values()))

    def metrics_df(self) -> DataFrame:
        return self._spark.createDataFrame(list(self._rows), METRICS)

    def late_rows(self, query) -> int:
        """Rows that all batches of a query dropped because they came after the watermark."""
        return self._late.get(str(query.runId), 0)

    def totals_df(self) -> DataFrame:
        """Input, output and late rows per query over all batches; the same in every run."""
        rows = [(name, *totals) for name, totals in self._totals.items()]
        return self._spark.createDataFrame(rows, "query string, input_rows bigint, output_rows bigint, late_rows bigint")
