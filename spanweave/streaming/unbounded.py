"""Overlap of two streams without any bound in time.

A stream-stream join would have to keep every span for ever. Here the spans that have come lie in
a partitioned table, and each micro-batch is joined with itself and with the part of the table that
its spans can touch: a span is filed under its level, so that cells of that level are just longer than
itself, and the cell in which it begins. A later span meets spans of a level in the cells from one before
its own begin to its end, so a micro-batch of about one time reads about one time from the
table, however long the spans are and however long the stream has run. Ids are not a partition: a
micro-batch touches nearly all of them.

Each batch writes its spans and its result to folders of its own and reads what earlier batches
wrote, so a repeated batch overwrites its own output only.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.times import millis
from spanweave.operators.keyed import HotKeyPolicy
from spanweave.operators.overlap import JOIN_POLICY, partial_overlap
from spanweave.schemas import to_zone_free
from spanweave.session import new_folder
from spanweave.streaming.run import finish, start_query

#: The finest cells are 2**26 ms (19 hours) long.
FINEST = 26
_STORED = "unique_id bigint, tower string, start_ts timestamp_ntz, end_ts timestamp_ntz, _batch bigint, _is_call boolean, _level int, _cell bigint"


def overlap_unbounded(
    calls: DataFrame,
    towers: DataFrame,
    *,
    tolerance_ms: int = 0,
    folder: str | None = None,
    policy: HotKeyPolicy | None = JOIN_POLICY,
) -> DataFrame:
    """Partly overlapping pairs of two streams, as ``partial_overlap`` finds them in tables.

    Rows without an id or a time take no part. Give the same ``folder`` to go on with what has arrived since.
    """
    spark = calls.sparkSession
    folder = folder or new_folder(spark, "unbounded")
    columns = ["unique_id", "start_ts", "end_ts"]
    both = calls.select(*columns, F.lit(None).cast("string").alias("tower"), F.lit(True).alias("_is_call")).unionByName(
        towers.select(*columns, "tower", F.lit(False).alias("_is_call"))
    )

    def one_batch(batch: DataFrame, number: int) -> None:
        rows = _filed(to_zone_free(batch), tolerance_ms).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            path = f"{folder}/spans/_batch={number}"
            rows.write.mode("overwrite").partitionBy("_is_call", "_level", "_cell").parquet(path)
            stored = None
            if number:
                stored = batch.sparkSession.read.schema(_STORED).parquet(f"{folder}/spans").where(F.col("_batch") < number)
            found = _pairs(_side(rows, True), _with_stored(rows, stored, False), tolerance_ms, policy)
            if stored is not None:
                older = stored.where("_is_call").where(_touched(rows, False))
                found = found.unionByName(_pairs(older, _side(rows, False), tolerance_ms, policy))
            found.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")
        finally:
            rows.unpersist()

    finish(start_query(both, "foreachBatch", batch_writer=one_batch, checkpoint=f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/result").drop("batch")


def _filed(rows: DataFrame, tolerance_ms: int) -> DataFrame:
    """``rows`` with the limits of the widened span, its level and the cell of its begin."""
    rows = rows.where("unique_id IS NOT NULL AND start_ts IS NOT NULL AND end_ts IS NOT NULL")
    low, high = F.least(millis("start_ts"), millis("end_ts")), F.greatest(millis("start_ts"), millis("end_ts"))
    rows = rows.withColumn("_lo", low - tolerance_ms).withColumn("_hi", high + tolerance_ms)
    level = F.greatest(F.length(F.bin(F.col("_hi") - F.col("_lo"))), F.lit(FINEST)).cast("int")
    return rows.withColumn("_level", level).withColumn("_cell", F.expr("shiftright(_lo, _level)"))


def _touched(rows: DataFrame, is_call: bool) -> Column:
    """Which partitions of the table the batch's spans of one kind can meet.

    One interval of time per level of the batch's spans, so a few long ones do not widen the others'.
    """
    limits = rows.where(F.col("_is_call") == is_call).groupBy("_level").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).collect()
    touched = F.lit(False)
    for r in limits:
        first, last = (F.call_function("shiftright", F.lit(v), F.col("_level")) for v in (r["lo"], r["hi"]))
        touched = touched | F.col("_cell").between(first - 1, last)
    return touched


def _side(rows: DataFrame, is_call: bool) -> DataFrame:
    return rows.where(F.col("_is_call") == is_call)


def _with_stored(rows: DataFrame, stored: DataFrame | None, is_call: bool) -> DataFrame:
    """The batch's spans of one kind, and the stored ones that the batch's other kind can meet."""
    names = ["unique_id", "tower", "start_ts", "end_ts"]
    new = _side(rows, is_call).select(*names)
    if stored is None:
        return new
    return new.unionByName(stored.where(F.col("_is_call") == is_call).where(_touched(rows, not is_call)).select(*names))


def _pairs(calls: DataFrame, towers: DataFrame, tolerance_ms: int, policy: HotKeyPolicy | None) -> DataFrame:
    return partial_overlap(calls, towers, tolerance_ms=tolerance_ms, policy=policy)
