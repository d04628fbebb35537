"""Keyed tables in buckets, unbounded overlap, start watermarks, update and complete mode, late rows, empty tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanweave.operators import gaps
from spanweave.operators.compare import reconcile
from spanweave.operators.overlap import overlap_by_start, partial_overlap
from spanweave.plans.catalog import catalog
from spanweave.schemas import EVENTS, to_zone_free
from spanweave.session import new_folder
from spanweave.sources import derived
from spanweave.streaming import carried, feeds, processors
from spanweave.streaming import operators as streams
from spanweave.streaming.buckets import BucketTable
from spanweave.streaming.feeds import extend_feed, stage_feed, stage_slices
from spanweave.streaming.metrics import BatchMetrics
from spanweave.streaming.run import finish, run_to_table, start_query
from spanweave.streaming.unbounded import overlap_unbounded
from tests.conftest import DATA, call_events_df, calls_df, seconds, towers_df
from tests.test_streaming import Source, found


def _rows(table):
    return [] if table is None else sorted((r.k, r.v) for r in table.collect())


def test_bucket_table_rewrites_only_what_a_batch_touches(spark):
    table = BucketTable(spark, new_folder(spark, "b"), ["k"], buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long")
    first = frame([(n, 0) for n in range(40)])
    table.replace(0, first, table.touched(first))
    assert _rows(table.read(table.versions(0))) == [(n, 0) for n in range(40)]
    hit = table.touched(frame([(5, 1)]))
    kept = table.read(table.versions(0), hit).where("k <> 5")
    table.replace(1, kept.unionByName(frame([(5, 1)])), hit)
    wanted = [(n, int(n == 5)) for n in range(40)]
    assert _rows(table.current()) == wanted
    assert sorted(table.versions(1).values()) == [0] * 7 + [1]
    # Batch 1 again, by a reader that knows nothing yet: the same start, the same end.
    again = BucketTable(spark, table.folder, ["k"], buckets=8)
    assert _rows(again.read(again.versions(0), hit)) == _rows(first.where(again.bucket() == hit[0]))
    again.replace(1, kept.unionByName(frame([(5, 1)])), hit)
    assert _rows(BucketTable(spark, table.folder, ["k"], buckets=8).current()) == wanted
    # Once batch 2 begins, what batch 1 replaced may go.
    again.forget_replaced(2)
    assert _rows(again.current()) == wanted
    assert f"bucket={hit[0]}" not in again._names(f"{table.folder}/rows/batch=0")


def test_emptied_buckets_leave_the_table(spark):
    table = BucketTable(spark, new_folder(spark, "b"), [], buckets=8)
    rows = spark.createDataFrame([(1, 1)], "k long, v long")
    assert table.current() is None
    table.replace(0, rows, table.touched(rows))
    table.replace(1, rows.where("false"), [0])
    assert table.versions(1) == {} and table.current() is None


def test_carried_batches_leave_idle_buckets_alone_and_read_rows_once(spark, tmp_path):
    frames = [calls_df(spark, [(n, n, n + 1, f"c{n}") for n in range(60)]), calls_df(spark, [(99, 100, 101, "c3")])]
    folder, step = new_folder(spark, "idle"), carried.running_max_step()
    with BatchMetrics(spark) as metrics:
        out = carried.run_carried(Source(spark, tmp_path, frames).read(), step, folder=folder)
        metrics.wait_for_all()
        assert sum(r.input_rows for r in metrics.metrics_df().collect()) == 61
    assert found(out) == [("c3", 4, 100)]
    versions = carried.carry_table(spark, folder, step).versions(1)
    assert sorted(versions.values()).count(1) == 1 and len(versions) > 8


def test_unbounded_overlap_of_spans_longer_than_any_delay(spark, tmp_path):
    year = 365 * 86_400
    calls = [(1, 0, 10 * year), (2, 5 * year, 5 * year + 10), (3, 0, 10), (4, 9 * year, 9 * year + 5)]
    towers = [(1, "a", 9 * year, 11 * year), (2, "b", 0, 5 * year + 5), (3, "c", 12, 20), (3, "d", 14, 20), (4, "e", 9 * year, 9 * year + 5), (2, "f", 5 * year + 9, 6 * year)]
    c, t = calls_df(spark, calls), towers_df(spark, towers)
    wanted = partial_overlap(c, t, tolerance_ms=3000).select("unique_id", "tower", "call_start", "tower_end")
    assert wanted.count() == 4
    for order in (1, -1):
        one = Source(spark, tmp_path, [c.where(F.col("unique_id") == n) for n in (1, 2, 3, 4)][::order])
        two = Source(spark, tmp_path, [t.where(F.col("tower") == n) for n in "fedcba"][::order])
        got = overlap_unbounded(one.read(), two.read(), tolerance_ms=3000)
        assert reconcile(wanted, got.select(wanted.columns)).count() == 0


def test_unbounded_overlap_reads_only_the_cells_it_touches(spark, tmp_path):
    from spanweave.streaming import unbounded

    days = [calls_df(spark, [(n, n * 30 * 86_400, n * 30 * 86_400 + 60)]) for n in range(12)]
    folder = new_folder(spark, "cells")
    overlap_unbounded(Source(spark, tmp_path, days).read(), Source(spark, tmp_path, [towers_df(spark, [(0, "a", 30, 90)])]).read(), folder=folder)
    stored = spark.read.schema(unbounded._STORED).parquet(f"{folder}/spans")
    late = unbounded._filed(towers_df(spark, [(7, "b", 7 * 30 * 86_400 + 30, 7 * 30 * 86_400 + 90)]).withColumn("_is_call", F.lit(False)), 0)
    assert [r.unique_id for r in stored.where("_is_call").where(unbounded._touched(late, False)).collect()] == [7]


@pytest.mark.parametrize("policy", ["min", "max"])
def test_watermarks_on_starts_with_a_delay_per_side(spark, tmp_path, policy):
    calls = [calls_df(spark, [(1, 0, 50)]), calls_df(spark, [(2, 500, 550)]), calls_df(spark, [(3, 1000, 1050)])]
    towers = [towers_df(spark, [(9, "z", 0, 1)]), towers_df(spark, [(9, "z", 1, 2)]), towers_df(spark, [(9, "z", 2, 3)]), towers_df(spark, [(1, "a", 20, 60), (3, "c", 990, 1010)])]
    out = overlap_by_start(
        Source(spark, tmp_path, calls).read(), Source(spark, tmp_path, towers).read(), longest_ms=60_000, call_delay="10 seconds", tower_delay="20 seconds"
    )
    got = sorted(r.tower for r in run_to_table(out, watermark_policy=policy).collect())
    # The towers lag behind: the faster input's watermark of two batches before drops the old one.
    assert got == (["a", "c"] if policy == "min" else ["c"])


def test_overlap_by_start_equals_the_plain_overlap_and_leaves_longer_spans_out(spark):
    calls, towers = derived.calls(spark, DATA), derived.towers(spark, DATA)
    assert reconcile(partial_overlap(calls, towers, tolerance_ms=3000), overlap_by_start(calls, towers, longest_ms=10**8, tolerance_ms=3000)).count() == 0
    assert overlap_by_start(calls_df(spark, [(1, 0, 100)]), towers_df(spark, [(1, "a", 50, 150)]), longest_ms=99_000).count() == 0


def test_updated_table_has_one_row_per_key_between_batches(spark, tmp_path):
    frames = [call_events_df(spark, [(1, 0, 10), (2, 0, 5)]), call_events_df(spark, [(1, 1, 30)]), call_events_df(spark, [(1, 0, 1), (None, 0, 3)])]
    source, folder, seen = Source(spark, tmp_path, frames[:1]), new_folder(spark, "up"), []
    for extra in (*frames[1:], None):
        rows = carried.rebuild_updating(source.read(), ["unique_id"], folder=folder)
        seen.append(sorted(((r.unique_id, seconds(r.start_ts), seconds(r.end_ts)) for r in rows.collect()), key=str))
        if extra is not None:
            source.add(extra)
    assert seen == [[(1, 10, 10), (2, 5, 5)], [(1, 10, 30), (2, 5, 5)], [(1, 1, 30), (2, 5, 5), (None, 3, 3)]]


def test_totals_in_complete_mode_are_sorted(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 5), ("a", 2), ("c", 3)], "caller string, gap_ms long")
    rows.write.parquet(f"{tmp_path}/t")
    out = carried.totals_per_key(f"{tmp_path}/t", rows.schema, "caller", "gap_ms", folder=new_folder(spark, "t"))
    assert [(r.caller, r.n, r.total) for r in out.coalesce(1).sortWithinPartitions(F.desc("total"), "caller").collect()] == [("b", 1, 5), ("a", 2, 3), ("c", 1, 3)]


def test_late_rows_are_counted_over_more_batches_than_a_query_remembers(spark, tmp_path):
    batches = 110
    rows = [(n, 1000 * n, 1000 * n + 1) for n in range(batches)] + [(1000, 20, 30)]
    calls = calls_df(spark, rows)
    place = F.when(F.col("unique_id") == 1000, 5).otherwise(F.least(F.col("unique_id") + F.when(F.col("unique_id") > 4, 1).otherwise(0), F.lit(batches - 1)))
    feed = stage_slices(calls, place, batches)
    taken = streams.admitted(feed.read(spark), key=["unique_id"], event_time="end_ts", delay="1 second")
    folder = new_folder(spark, "late")
    with BatchMetrics(spark, keep=3) as metrics:
        query = start_query(taken, "parquet", path=f"{folder}/t", checkpoint=f"{folder}/c", partitions=1)
        finish(query)
        metrics.wait_for_end(query)
    assert len(query.recentProgress) <= 100 and metrics.late_rows(query) == 1
    assert metrics.metrics_df().count() == 3
    late = streams.late_table(calls, spark.read.schema(taken.schema).parquet(f"{folder}/t"), ["unique_id"])
    assert [r.unique_id for r in late.collect()] == [1000]


def test_calls_matched_natively_equal_paired_calls(spark, tmp_path):
    frames = [
        call_events_df(spark, [(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 0, 2), (4, 1, 2), (None, 0, 1)]),
        call_events_df(spark, [(1, 1, 9), (5, 1, 9), (3, 0, 9)]),
        call_events_df(spark, [(2, 1, 30), (5, 0, 9)]),
    ]
    both = [
        run_to_table(streams.match_calls(Source(spark, tmp_path, frames).read(), delay="1 hour", max_open_ms=10_000)),
        run_to_table(streams.pair_calls(Source(spark, tmp_path, frames).read(), delay="1 hour", max_open_ms=10_000)),
    ]
    got = [sorted((r.unique_id, seconds(r.start_ts), seconds(r.end_ts)) for r in rows.collect()) for rows in both]
    assert got[0] == got[1] == [(1, 0, 9), (4, 2, 2)]


def test_feeds_keep_their_order_whatever_the_tasks_do(spark):
    calls = derived.calls(spark, DATA)
    half = F.col("unique_id") % 2 == 0
    feed = extend_feed(stage_feed(calls.where(half), gaps.BY_START, slices=3), stage_feed(calls.where(~half), gaps.BY_START, slices=2))
    back = spark.read.schema(feed.schema).parquet(feed.path)
    assert reconcile(calls, back).count() == 0
    firsts = back.groupBy(F.col("_metadata.file_modification_time").alias("m")).agg(F.min("start_ts").alias("s"), F.max(F.col("unique_id") % 2).alias("odd"))
    listed = firsts.orderBy("m").collect()
    assert feed.files == len(listed) == 5 and [r.odd for r in listed] == [0, 0, 0, 1, 1]
    assert [r.s for r in listed[:3]] == sorted(r.s for r in listed[:3])


@pytest.mark.parametrize("name", ["stream_q2_bounded", "stream_q10_lag_carried", "stream_q10_running_max", "stream_q2_tolerant_unbounded", "stream_rebuild_calls_updated", "stream_late_rows", "stream_q10_running_max_restarted", "stream_q2_minmax"])
def test_streams_over_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    assert catalog()[name](spark, str(tmp_path)).count() == 0


# --- the processors alone -----------------------------------------------------------


class _State:
    def __init__(self):
        self.value, self.gets, self.puts = None, 0, 0

    def get(self):
        self.gets += 1
        return self.value

    def update(self, value):
        self.puts += 1
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.state, self.timers = _State(), []

    def getValueState(self, *_):
        return self.state

    def registerTimer(self, at):
        self.timers.append(at)


class _Clock:
    now = 0

    def getCurrentWatermarkInMs(self):
        return self.now


def _gap_frame(callers, start, end):
    return pd.DataFrame({"caller": callers, "at_ms": start, "tie": np.arange(len(start)), "start_ms": start, "end_ms": end})


@pytest.mark.parametrize("latest", [False, True])
def test_vector_fold_equals_a_loop(latest):
    rng = np.random.default_rng(5)
    processor, handle = processors.GapProcessor(latest), _Handle()
    processor.init(handle)
    last, wanted, got = {}, [], []
    for batch in range(6):
        n = 200
        callers = [None if c == 0 else f"c{c}" for c in rng.integers(0, 12, n)]
        start = rng.integers(-500, 500, n) + 400 * batch
        end = start + rng.integers(-3, 60, n)
        frame = _gap_frame(callers, start, end.astype(float))
        frame.loc[rng.random(n) < 0.2, "end_ms"] = np.nan
        frame["start_ms"] = frame["start_ms"].astype(float).mask(rng.random(n) < 0.2)
        for r in sorted(frame.itertuples(), key=lambda r: (str(r.caller), r.at_ms, r.tie)):
            known = last.get(r.caller)
            if not np.isnan(r.start_ms) and known is not None and r.start_ms > known:
                wanted.append((str(r.caller), known, r.start_ms, r.start_ms - known))
            if not np.isnan(r.end_ms) and (known is None or latest or r.end_ms > known):
                last[r.caller] = r.end_ms
        for out in processor.handleInputRows((1,), iter([frame]), _Clock()):
            got += [(str(r.caller), r.prev_end_ms, r.next_start_ms, r.gap_ms) for r in out.itertuples()]
    assert sorted(got) == sorted(wanted) and len(got) > 100
    assert (handle.state.gets, handle.state.puts) == (6, 6)


def test_idle_keys_are_passed_over_a_bounded_number_of_times():
    keep, n = 1_600_000, 100_000
    processor, handle, clock = processors.GapProcessor(False, ttl_ms=keep), _Handle(), _Clock()
    processor.init(handle)
    # 100,000 keys, each due at another time.
    start = np.arange(n, dtype=np.int64) * 16 + 10**12
    list(processor.handleInputRows((1,), iter([_gap_frame([f"c{i}" for i in range(n)], start, start)]), clock))
    fired = 0
    while handle.timers:
        clock.now = handle.timers.pop()
        list(processor.handleExpiredTimer((1,), clock, None))
        fired += 1
        left = processor._load()[0]["since_ms"]
        assert (left > clock.now - keep).all() and len(left) == (start > clock.now - keep).sum()
    assert handle.state.value is None and fired <= processors.SLOTS + 2


def test_file_times_do_not_depend_on_the_clock_of_tasks(spark):
    feed = stage_feed(derived.calls(spark, DATA), gaps.BY_START, slices=4)
    paths, system = feeds._files(spark, feed.path)
    assert [system.getFileStatus(p).getModificationTime() for p in paths] == [feeds._time_of(feed, n) for n in range(4)]
