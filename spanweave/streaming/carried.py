"""Streams worked through as a chain of batches, each handing a small table to the next.

The batch operators run inside ``foreachBatch`` on each micro-batch and on what the batches
before it left behind: per key, the value a look-back would find there. Everything stays in
the JVM and hot keys are split as in batch. What is left behind lies in hash buckets
(``BucketTable``): a micro-batch reads and rewrites the buckets of its own keys, so idle keys cost
nothing, and it is itself read from the source once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanweave.functions.predicates import is_connected
from spanweave.functions.times import millis
from spanweave.operators import gaps, sessions
from spanweave.operators.keyed import DEFAULT_POLICY, HotKeyPolicy, carry_after
from spanweave.schemas import to_zone_free
from spanweave.session import new_folder
from spanweave.streaming.buckets import BUCKETS, BucketTable
from spanweave.streaming.run import finish, start_query

Step = Callable[[DataFrame, "DataFrame | None"], "tuple[DataFrame, DataFrame | None]"]


def run_carried(
    stream: DataFrame,
    step: Step,
    *,
    carries: bool = True,
    folder: str | None = None,
    timeout_s: float | None = None,
    buckets: int = BUCKETS,
    sweep_after: int = 16,
) -> DataFrame:
    """Run ``step(batch, carry) -> (result, next carry)`` over the stream to its end.

    The carry holds the buckets that the batch's keys (``step.key``; without one there is a single
    bucket) fall into; it is None where nothing was carried, and always with ``carries=False``.
    Where a step forgets (``step.forgets``), a bucket that ``sweep_after`` batches have not written is
    handed over as well. Give the same ``folder`` again to go on with what has arrived since.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, "carried")
    table = carry_table(spark, folder, step, buckets)

    def one_batch(batch: DataFrame, number: int) -> None:
        if not carries:
            # Read once, so nothing is kept.
            step(to_zone_free(batch), None)[0].write.mode("overwrite").parquet(f"{folder}/result/batch={number}")
            return
        rows = to_zone_free(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            table.forget_replaced(number)
            versions, touched = table.versions(number - 1), table.touched(rows)
            if getattr(step, "forgets", False):
                touched += [b for b, written in versions.items() if b not in touched and written <= number - sweep_after]
            result, following = step(rows, table.read(versions, touched))
            result.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")
            table.replace(number, following, touched)
        finally:
            rows.unpersist()

    query = start_query(
        stream, "foreachBatch", batch_writer=one_batch, checkpoint=f"{folder}/checkpoint"
    )
    finish(query, timeout_s)
    return spark.read.parquet(f"{folder}/result").drop("batch")


def carry_table(spark: SparkSession, folder: str, step: Step, buckets: int = BUCKETS) -> BucketTable:
    """What the batches run in ``folder`` have left behind."""
    return BucketTable(spark, f"{folder}/carry", [step.key] if getattr(step, "key", None) else [], buckets)


def _keyed(step: Step, key: str, keep_ms: int | None) -> Step:
    step.key, step.forgets = key, keep_ms is not None
    return step


# With ``ttl_ms`` (or ``max_open_ms``) a step reports nothing longer and carries nothing on
# that lies further back from the newest row, so that the carry does not grow for ever.
# ``disorder_ms`` says how far rows of a later batch may lie before rows of an earlier one.


def running_max_step(
    ttl_ms: int | None = None, disorder_ms: int = 0, policy: HotKeyPolicy | None = DEFAULT_POLICY
) -> Step:
    """Step for gaps to the latest end so far of connected calls."""

    def step(calls: DataFrame, carry: DataFrame | None):
        rows = calls.where(is_connected() & F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
        out = gaps.gap_running_max(rows, ttl_ms=ttl_ms, seed=carry, policy=policy)
        ends = carry_after(rows, "caller", gaps.BY_START, F.col("end_ts"), latest=False, seed=carry)
        return out, _recent(ends, "carried", rows, "start_ts", ttl_ms, disorder_ms)

    return _keyed(step, "caller", ttl_ms)


def lag_step(ttl_ms: int | None = None, disorder_ms: int = 0, policy: HotKeyPolicy | None = DEFAULT_POLICY) -> Step:
    """Step for gaps to the end of the previous connected call."""

    def step(calls: DataFrame, carry: DataFrame | None):
        rows = calls.where(is_connected() & F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
        out = gaps.gap_lag(rows, ttl_ms=ttl_ms, seed=carry, policy=policy).drop("gap_duration")
        ends = carry_after(rows, "caller", gaps.BY_START, F.col("end_ts"), latest=True, seed=carry)
        return out, _recent(ends, "carried", rows, "start_ts", ttl_ms, disorder_ms)

    return _keyed(step, "caller", ttl_ms)


def last_end_step(
    ttl_ms: int | None = None, disorder_ms: int = 0, policy: HotKeyPolicy | None = DEFAULT_POLICY
) -> Step:
    """Step for gaps from the last END event."""

    def step(events: DataFrame, carry: DataFrame | None):
        out = gaps.gap_events_last_end(events, ttl_ms=ttl_ms, seed=carry, policy=policy)
        ends = carry_after(events, "caller", gaps.BY_EVENT, gaps.last_end_carry(), latest=False, seed=carry)
        return out, _recent(ends, "carried", events, "ts", ttl_ms, disorder_ms)

    return _keyed(step, "caller", ttl_ms)


def adjacent_step(
    ttl_ms: int | None = None, disorder_ms: int = 0, policy: HotKeyPolicy | None = DEFAULT_POLICY
) -> Step:
    """Step for each START that directly follows an END of a connected call."""

    def step(events: DataFrame, carry: DataFrame | None):
        rows = events.where(is_connected())
        out = gaps.gap_events_adjacent(rows, ttl_ms=ttl_ms, seed=carry, policy=policy)
        last = carry_after(rows, "caller", gaps.BY_EVENT, F.struct("event_type", "ts"), latest=True, seed=carry)
        return out, _recent(last, "carried.ts", rows, "ts", ttl_ms, disorder_ms)

    return _keyed(step, "caller", ttl_ms)


def pattern_step(
    ttl_ms: int | None = None, disorder_ms: int = 0, policy: HotKeyPolicy | None = DEFAULT_POLICY
) -> Step:
    """Step for two connected calls with no other call in between."""

    def step(calls: DataFrame, carry: DataFrame | None):
        rows = calls.where(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
        out = gaps.gap_pattern(rows, ttl_ms=ttl_ms, seed=carry, policy=policy)
        last = carry_after(rows, "caller", gaps.BY_START, F.struct("end_ts", "disposition"), latest=True, seed=carry)
        return out, _recent(last, "carried.end_ts", rows, "start_ts", ttl_ms, disorder_ms)

    return _keyed(step, "caller", ttl_ms)


def pair_step(
    from_start: tuple[str, ...] = (),
    from_end: tuple[str, ...] = (),
    max_open_ms: int | None = None,
    disorder_ms: int = 0,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
) -> Step:
    """Step that pairs events into spans; only open spans are carried on."""

    def step(events: DataFrame, carry: DataFrame | None):
        out = sessions.pair_spans(
            events, from_start=from_start, from_end=from_end, max_open_ms=max_open_ms, seed=carry, policy=policy
        )
        opened = sessions.open_spans(events, from_start=from_start, seed=carry)
        return out, _recent(opened, "carried.ts", events, "ts", max_open_ms, disorder_ms)

    return _keyed(step, "unique_id", max_open_ms)


def _recent(
    carry: DataFrame, when: str, rows: DataFrame, time: str, keep_ms: int | None, disorder_ms: int
) -> DataFrame:
    if keep_ms is None:
        return carry
    newest = rows.agg(F.max(millis(time))).first()[0]
    if newest is None:
        return carry
    return carry.where(millis(when) >= newest - keep_ms - disorder_ms)


def rebuild_partials(stream: DataFrame, keys: list[str], *, folder: str | None = None) -> DataFrame:
    """First and last event per key over a stream whose results may change until it ends.

    Each batch adds its own minimum and maximum per key; reading combines them. Nothing
    written is ever rewritten, and no state is kept.
    """

    def step(events: DataFrame, carry: DataFrame | None):
        return sessions.rebuild_spans(events, keys), None

    partials = run_carried(stream, step, carries=False, folder=folder)
    return partials.groupBy(*keys).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def rebuild_updating(stream: DataFrame, keys: list[str], *, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """First and last event per key, corrected while the stream runs.

    An aggregation in update mode hands on the keys that changed, and each batch puts them into
    a keyed table in place of their former rows: between batches readers see one row per key, and a
    repeated batch changes nothing. The aggregation's state keeps every key, as results may change until the stream ends.
    """
    table = BucketTable(stream.sparkSession, f"{folder}/table", keys, buckets)

    def upsert(batch: DataFrame, number: int) -> None:
        table.forget_replaced(number)
        rows = to_zone_free(batch).persist(StorageLevel.MEMORY_AND_DISK)
        touched = table.touched(rows)
        held = table.read(table.versions(number - 1), touched)
        if held is not None:
            same = [F.col(f"held.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
            kept = held.alias("held").join(rows.alias("new"), reduce(and_, same), "left_anti")
            table.replace(number, kept.unionByName(rows), touched)
        else:
            table.replace(number, rows, touched)
        rows.unpersist()

    changed = sessions.rebuild_spans(stream, keys)
    query = start_query(changed, "foreachBatch", batch_writer=upsert, checkpoint=f"{folder}/checkpoint", output_mode="update")
    finish(query)
    found = table.current()
    return stream.sparkSession.createDataFrame([], to_zone_free(changed).schema) if found is None else found


def totals_per_key(table: str, schema: StructType, key: str, value: str, *, folder: str) -> DataFrame:
    """Count and sum of ``value`` per key over a table that a stream writes, sorted within the stream.

    Complete mode hands on the whole sorted result with every batch; the last one is returned. The
    result has a row per key, so it is for reports.
    """
    spark = SparkSession.active()
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(table)
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).orderBy(F.desc("total"), key)

    def one_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/totals")

    finish(start_query(totals, "foreachBatch", batch_writer=one_batch, checkpoint=f"{folder}/checkpoint", output_mode="complete"))
    return spark.read.schema(totals.schema).parquet(f"{folder}/totals")
