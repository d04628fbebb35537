from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanweave import schemas
from spanweave.operators import gaps
from spanweave.operators.compare import reconcile
from spanweave.operators.keyed import HotKeyPolicy
from spanweave.operators.overlap import bounded_overlap
from spanweave.schemas import to_instants
from spanweave.session import new_folder
from spanweave.sources import derived, signals
from spanweave.streaming import carried, feeds
from spanweave.streaming import operators as streams
from spanweave.streaming.feeds import stage_feed
from spanweave.streaming.metrics import BatchMetrics
from spanweave.streaming.run import finish, run_to_table, start_query
from tests.conftest import DATA, call_events_df, calls_df, seconds, tower_events_df, towers_df


class Source:
    """A folder that gets one file per batch."""

    def __init__(self, spark, tmp_path, frames):
        self.spark, self.path, self.schema = spark, str(tmp_path / new_folder(spark, "s")[-8:]), frames[0].schema
        for frame in frames:
            self.add(frame)

    def add(self, frame):
        frame.coalesce(1).write.mode("append").parquet(self.path)

    def read(self):
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)
        return to_instants(rows)


def found(df):
    return sorted((r.caller, seconds(r.prev_end), seconds(r.next_start)) for r in df.collect())


def test_gap_folds_differ(spark, tmp_path):
    source = Source(spark, tmp_path, [calls_df(spark, [(1, 0, 10), (2, 1, 2)]), calls_df(spark, [(3, 5, 6)])])
    assert found(run_to_table(streams.gaps_from_calls(source.read(), delay="1 hour"))) == []
    assert found(run_to_table(streams.gaps_from_calls(source.read(), delay="1 hour", latest=True))) == [("a", 2, 5)]


def test_two_starts_after_one_end(spark, tmp_path):
    frames = [call_events_df(spark, [(1, 0, 0), (1, 1, 1)]), call_events_df(spark, [(2, 0, 3), (3, 0, 5)])]
    source = Source(spark, tmp_path, frames)
    assert found(run_to_table(streams.gaps_from_events(source.read(), delay="1 hour"))) == [("a", 1, 3), ("a", 1, 5)]
    assert found(carried.run_carried(source.read(), carried.last_end_step())) == [("a", 1, 3), ("a", 1, 5)]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    frames = [calls_df(spark, [(1, 0, 1)]), calls_df(spark, [(2, 1000, 1001)]), calls_df(spark, [(3, 1001.5, 1002)])]
    frames += [calls_df(spark, [(4, 20, 30, "late")]), calls_df(spark, [(5, 1010, 1011)])]
    out = streams.gaps_from_calls(Source(spark, tmp_path, frames).read(), delay="10 seconds")
    with BatchMetrics(spark) as metrics:
        query = start_query(out, "noop", checkpoint=new_folder(spark, "c"), name="late")
        finish(query)
        assert metrics.wait_for_end(query)
        rows = metrics.metrics_df().collect()
    assert sum(r.late_rows_dropped for r in rows) == 1
    assert sum(r.input_rows for r in rows) == 5
    assert [r.batch_id for r in rows] == sorted(r.batch_id for r in rows)


def test_ttl_frees_state_and_hides_long_gaps(spark, tmp_path):
    frames = [
        calls_df(spark, [(n, 0, 1, f"c{n}") for n in range(20)]),
        calls_df(spark, [(30, 5000, 5001, "x")]),
        calls_df(spark, [(31, 5002, 5003, "x"), (32, 5002, 5003, "c1")]),
    ]
    out = streams.gaps_from_calls(Source(spark, tmp_path, frames).read(), delay="10 seconds", ttl_ms=60_000)
    folder = new_folder(spark, "t")
    query = start_query(out, "parquet", path=f"{folder}/t", checkpoint=f"{folder}/c")
    finish(query)
    rows = schemas.to_zone_free(spark.read.parquet(f"{folder}/t"))
    assert found(rows) == [("x", 5001, 5002)]
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 6  # of 21 callers


def test_timer_before_the_watermark_is_no_error(spark, tmp_path):
    # The second row is admitted (its end is recent), but its start lies far back.
    frames = [calls_df(spark, [(1, 1000, 1001, "a")]), calls_df(spark, [(2, 1, 995, "b")]), calls_df(spark, [(3, 1100, 1101, "b")])]
    out = streams.gaps_from_calls(Source(spark, tmp_path, frames).read(), delay="10 seconds", ttl_ms=1)
    assert found(run_to_table(out)) == []


@pytest.mark.parametrize("form", ["state", "carried"])
def test_restart_goes_on(spark, tmp_path, form):
    source = Source(spark, tmp_path, [calls_df(spark, [(1, 0, 1)]), calls_df(spark, [(2, 3, 4)])])
    folder = new_folder(spark, "restart")

    def run():
        if form == "carried":
            return carried.run_carried(source.read(), carried.running_max_step(), folder=folder)
        out = streams.gaps_from_calls(source.read(), delay="1 hour")
        finish(start_query(out, "parquet", path=f"{folder}/t", checkpoint=f"{folder}/c"))
        return schemas.to_zone_free(spark.read.schema(out.schema).parquet(f"{folder}/t"))

    assert found(run()) == [("a", 1, 3)]
    source.add(calls_df(spark, [(3, 9, 10)]))
    assert found(run()) == [("a", 1, 3), ("a", 4, 9)]
    assert found(run()) == [("a", 1, 3), ("a", 4, 9)]


def test_failed_batch_is_repeated_once(spark, tmp_path):
    source = Source(spark, tmp_path, [calls_df(spark, [(1, 0, 1)]), calls_df(spark, [(2, 3, 4)])])
    folder = new_folder(spark, "fail")
    calls = []

    def failing(batch, carry):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return carried.running_max_step()(batch, carry)

    with pytest.raises(Exception, match="lost"):
        carried.run_carried(source.read(), failing, folder=folder)
    assert found(carried.run_carried(source.read(), failing, folder=folder)) == [("a", 1, 3)]


def test_carried_form_splits_hot_callers(spark):
    calls = derived.calls(spark, DATA)
    feed = stage_feed(calls, gaps.BY_START, slices=3)
    out = carried.run_carried(feed.read(spark), carried.lag_step(policy=HotKeyPolicy(rows_per_task=15)))
    assert reconcile(gaps.gap_lag(calls).drop("gap_duration"), out).count() == 0


def test_carry_with_a_limit_does_not_grow(spark, tmp_path):
    frames = [calls_df(spark, [(n, n, n + 1, f"c{n}") for n in range(9)]), calls_df(spark, [(20, 12, 13, "c8"), (21, 20, 21, "c8")])]
    source, folder = Source(spark, tmp_path, frames), new_folder(spark, "limit")
    step = carried.running_max_step(ttl_ms=4000)
    assert found(carried.run_carried(source.read(), step, folder=folder, sweep_after=1)) == [("c8", 9, 12)]
    table = carried.carry_table(spark, folder, step)
    assert [r.caller for r in table.current().collect()] == ["c8"]
    assert table.read(table.versions(0)).count() == 6


def test_carried_open_spans_are_forgotten(spark, tmp_path):
    frames = [tower_events_df(spark, [(1, "A", 0, 0), (2, "B", 0, 50)]), tower_events_df(spark, [(2, "B", 1, 55), (1, "A", 1, 56)])]
    step = carried.pair_step(from_start=("tower",), max_open_ms=10_000)
    out = carried.run_carried(Source(spark, tmp_path, frames).read(), step)
    assert [r.unique_id for r in out.collect()] == [2]


@pytest.mark.parametrize("latest", [False, True])
def test_unlimited_and_wide_limits_agree(spark, latest):
    feed = stage_feed(derived.calls(spark, DATA), gaps.BY_START, slices=2)
    make = carried.lag_step if latest else carried.running_max_step
    wide = 40 * 86_400_000
    a = carried.run_carried(feed.read(spark), make())
    b = carried.run_carried(feed.read(spark), make(ttl_ms=wide, disorder_ms=wide))
    assert reconcile(a, b).count() == 0


@pytest.mark.parametrize(("form", "policy"), [("state", None), ("carried", None), ("carried", HotKeyPolicy(1))])
def test_pairing_over_batches(spark, tmp_path, form, policy):
    frames = [
        tower_events_df(spark, [(1, "A", 0, 0), (2, "B", 1, 0), (3, "C", 0, 0)]),
        tower_events_df(spark, [(1, "A", 1, 5), (1, "D", 0, 5), (3, "E", 0, 6)]),
        tower_events_df(spark, [(1, "D", 1, 9), (3, "E", 1, 8), (2, "B", 1, 9)]),
    ]
    source = Source(spark, tmp_path, frames)
    if form == "carried":
        out = carried.run_carried(source.read(), carried.pair_step(from_start=("tower",), policy=policy))
    else:
        out = run_to_table(streams.pair_towers(source.read(), delay="1 hour"))
    got = sorted((r.unique_id, r.tower, seconds(r.start_ts), seconds(r.end_ts)) for r in out.collect())
    assert got == [(1, "A", 0, 5), (1, "D", 5, 9), (3, "E", 6, 8)]


def test_open_spans_are_forgotten(spark, tmp_path):
    frames = [
        tower_events_df(spark, [(n, "A", 0, 0) for n in range(20)]),
        tower_events_df(spark, [(50, "B", 0, 5000)]),
        tower_events_df(spark, [(50, "B", 1, 5001), (3, "A", 1, 5001)]),
    ]
    out = streams.pair_towers(Source(spark, tmp_path, frames).read(), delay="10 seconds", max_open_ms=60_000)
    query = start_query(out, "memory", name="forgotten", checkpoint=new_folder(spark, "c"))
    finish(query)
    assert [r.unique_id for r in spark.table("forgotten").collect()] == [50]
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3  # the timer of one bucket


def test_join_state_is_dropped(spark):
    calls, towers = derived.calls(spark, DATA), derived.towers(spark, DATA)
    c = stage_feed(calls, gaps.BY_START, slices=6)
    t = stage_feed(towers, ["start_ts", "row_id"], slices=6)
    out = bounded_overlap(c.read(spark), t.read(spark), bound_ms=10_000, delay="2 days")
    query = start_query(out, "noop", checkpoint=new_folder(spark, "c"))
    finish(query)
    removed = sum(s.numRowsRemoved for p in query.recentProgress for s in p.stateOperators)
    assert removed > 2000
    assert query.lastProgress.stateOperators[0].numRowsTotal < 1000
    assert sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators) == 0


def test_join_of_sessions_drops_its_state(spark):
    c = stage_feed(derived.call_events(spark, DATA), gaps.BY_EVENT, slices=6)
    t = stage_feed(derived.tower_events(spark, DATA), gaps.BY_EVENT, slices=6)
    out = streams.overlap_of_sessions(c.read(spark), t.read(spark), bound_ms=10_000, delay="12 hours", max_open_ms=43_200_000)
    query = start_query(out, "noop", checkpoint=new_folder(spark, "c"))
    finish(query)
    join = [s for s in query.lastProgress.stateOperators if s.operatorName == "symmetricHashJoin"][0]
    assert join.numRowsTotal < 1500  # of 2,900 spans in 6 slices


def test_console_sink_and_csv_stream(spark):
    feed = stage_feed(derived.calls(spark, DATA), gaps.BY_START, slices=2, csv=True)
    calls = signals.read_calls(spark, feed.path, streaming=True, files_per_batch=1)
    query = start_query(calls.select("unique_id"), "console", checkpoint=new_folder(spark, "c"), truncate=False)
    assert finish(query) > 0
    assert "Console" in query.lastProgress.sink.description and query.lastProgress.batchId == 1
    by_size = signals.read_calls(spark, feed.path, streaming=True, bytes_per_batch=1000)
    assert run_to_table(by_size).count() == 1000


def test_running_query_can_be_stopped(spark, tmp_path):
    source = Source(spark, tmp_path, [calls_df(spark, [(1, 0, 1)])])
    query = start_query(source.read(), "noop", checkpoint=new_folder(spark, "c"), until_done=False, every="1 second")
    with pytest.raises(TimeoutError):
        finish(query, timeout_s=3)
    assert not query.isActive


def test_feed_keeps_every_row_in_time_order(spark):
    calls = derived.calls(spark, DATA)
    feed = stage_feed(calls, gaps.BY_START, slices=4)
    back = spark.read.schema(feed.schema).parquet(feed.path)
    assert reconcile(calls, back).count() == 0
    per_file = back.groupBy(F.col("_metadata.file_modification_time").alias("m")).agg(F.min("start_ts").alias("s"))
    starts = [r.s for r in per_file.orderBy("m").collect()]
    assert len(starts) == 4 and starts == sorted(starts)


def test_large_feeds_get_more_slices_and_files(spark, monkeypatch):
    monkeypatch.setattr(feeds, "_ROWS_PER_SLICE", 200)
    monkeypatch.setattr(feeds, "_ROWS_PER_FILE", 50)
    calls = derived.calls(spark, DATA)
    feed = stage_feed(calls, gaps.BY_START, slices=2)
    back = spark.read.schema(feed.schema).parquet(feed.path)
    assert reconcile(calls, back).count() == 0
    assert (feed.files_per_slice, len(back.inputFiles())) == (4, 20)
    out = run_to_table(streams.gaps_from_calls(feed.read(spark), delay="2 days", buckets=8))
    assert reconcile(gaps.gap_running_max(calls), out).count() == 0


def test_batch_and_stream_overlap_agree_on_edges(spark, tmp_path):
    calls = calls_df(spark, [(1, 10, 20), (2, 10, 10), (3, 0, 100)])
    towers = towers_df(spark, [(1, "a", 5, 20), (1, "b", 15, 30), (1, "c", 15, 31), (2, "d", 9, 11), (3, "e", 50, 101)])
    batch = bounded_overlap(calls, towers, bound_ms=10_000)
    c, t = Source(spark, tmp_path, [calls]).read(), Source(spark, tmp_path, [towers]).read()
    stream = run_to_table(bounded_overlap(c, t, bound_ms=10_000, delay="1 minute"))
    assert reconcile(batch, stream).count() == 0
    assert sorted(r.tower for r in batch.collect()) == ["a", "b", "d", "e"]
