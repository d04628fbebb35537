"""Starting streaming queries, waiting for them, and reading what they wrote."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanweave.schemas import to_zone_free
from spanweave.session import new_folder, prepare_session, setting, state_partitions
from spanweave.streaming.metrics import BatchMetrics


def start_query(
    df: DataFrame,
    sink: str = "console",
    *,
    checkpoint: str,
    path: str | None = None,
    name: str | None = None,
    batch_writer: Callable[[DataFrame, int], None] | None = None,
    output_mode: str = "append",
    truncate: bool = True,
    until_done: bool = True,
    every: str | None = None,
    partitions: int | None = None,
    watermark_policy: str = "min",
) -> StreamingQuery:
    """Start a query that writes ``df`` to ``console``, ``memory``, ``noop``, a file format
    such as ``parquet``, or ``foreachBatch`` (with ``batch_writer``).

    ``checkpoint`` is required: a query started again with it goes on where it stopped.
    ``until_done`` works through what is there and stops; otherwise the query keeps
    running, with a batch ``every`` interval if given. With several inputs the watermark follows
    the slowest one (``watermark_policy="min"``) or the fastest (``"max"``, which drops the rows
    of a slower input that come later).
    """
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if until_done:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    if sink == "foreachBatch":
        writer = writer.foreachBatch(batch_writer)
    else:
        writer = writer.format(sink)
        if sink == "console":
            writer = writer.option("truncate", str(truncate).lower())
        if path:
            writer = writer.option("path", path)
    spark = prepare_session(df.sparkSession)
    with state_partitions(spark, partitions), setting(spark, "spark.sql.streaming.multipleWatermarkPolicy", watermark_policy):
        return writer.start()


def finish(query: StreamingQuery, timeout_s: float | None = None) -> int:
    """Wait until the query ends and return the time waited in ms. Fails when it fails.

    Waits as long as it takes unless ``timeout_s`` is given, after which the query is stopped.
    """
    began = time.monotonic()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"query {query.name or query.id} did not end within {timeout_s} s")
    return round((time.monotonic() - began) * 1000)


def run_to_table(
    df: DataFrame, *, timeout_s: float | None = None, name: str | None = None, allow_late: bool = True, **options
) -> DataFrame:
    """Run a streaming DataFrame to its end into a new parquet table and return the table,
    with zone-free times. With ``allow_late=False`` dropped late rows are an error."""
    spark = df.sparkSession
    folder = new_folder(spark, "run")
    with BatchMetrics(spark, keep=0) as metrics:
        query = start_query(df, "parquet", path=f"{folder}/table", checkpoint=f"{folder}/checkpoint", name=name, **options)
        finish(query, timeout_s)
        metrics.wait_for_end(query)
    if not allow_late and (dropped := metrics.late_rows(query)):
        raise RuntimeError(f"{dropped} rows came after the watermark; allow a longer delay")
    return to_zone_free(spark.read.schema(df.schema).parquet(f"{folder}/table"))
