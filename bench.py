"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default: all) choose the
data and the cores. Batch queries: the median of three runs after one warm-up run, written
to the ``noop`` sink. Stream queries: one run each, including the writing of the files they
read; ``streams`` reports the micro-batches alone.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from spanweave.plans.catalog import catalog
from spanweave.streaming.metrics import BatchMetrics

BATCH = [
    "connected_calls",
    "q2_overlap",
    "q2_overlap_tolerant",
    "q2_overlap_bounded",
    "q2_overlap_events_minmax",
    "q2_overlap_events_sessions",
    "q10_gap_lag",
    "q10_gap_running_max",
    "q10_gap_events_adjacent",
    "q10_gap_events_last_end",
    "q10_gap_pattern",
    "rebuild_calls",
    "rebuild_towers",
    "pair_calls",
    "pair_towers",
    "reconcile_lag_vs_runmax",
]
STREAMS = [
    "stream_q2_bounded",
    "stream_q2_sessions",
    "stream_q10_running_max",
    "stream_q10_running_max_carried",
]


def _run(query, spark: SparkSession, folder: str) -> float:
    began = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def _stream_facts(metrics: BatchMetrics) -> dict:
    rows = metrics.metrics_df().collect()
    latencies = [r.latency_ms for r in rows]
    total = sum(latencies)
    return {
        "batches": len(rows),
        "input_rows": sum(r.input_rows for r in rows),
        "rows_per_sec": round(sum(r.input_rows for r in rows) * 1000 / total) if total else None,
        "p50_batch_ms": statistics.median(latencies) if latencies else None,
        "max_batch_ms": max(latencies, default=None),
        "peak_state_rows": max((r.state_rows for r in rows), default=None),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spanweave-bench")
        .config("spark.sql.shuffle.partitions", str(os.cpu_count() if cpus == "*" else cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spanweave-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds, streams = catalog(), {}, {}
    for name in BATCH:
        _run(known[name], spark, folder)
        seconds[name] = statistics.median(_run(known[name], spark, folder) for _ in range(3))
        print(name, seconds[name], file=sys.stderr)
    for name in STREAMS:
        with BatchMetrics(spark) as metrics:
            seconds[name] = _run(known[name], spark, folder)
            metrics.wait_for_all()
            streams[name] = _stream_facts(metrics)
        print(name, seconds[name], streams[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "streams": streams,
                "sf": os.path.basename(folder).removeprefix("sf"),
                "cores": spark.sparkContext.defaultParallelism,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
