"""Joins of two streams on buckets of keys: what they find, and how little state they touch row by row."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.operators import gaps
from spanweave.operators.compare import reconcile
from spanweave.operators.overlap import partial_overlap
from spanweave.operators.sessions import rebuild_spans
from spanweave.schemas import to_zone_free
from spanweave.session import new_folder
from spanweave.sources import derived
from spanweave.streaming import operators as streams
from spanweave.streaming.feeds import stage_feed
from spanweave.streaming.processors import NearProcessor
from spanweave.streaming.run import finish, run_to_table, start_query
from tests.conftest import DATA, EPOCH, call_events_df, seconds, tower_events_df
from tests.test_streaming import Source


def run_watched(df):
    """The rows that a stream writes, and the most entries that one of its operators held in any batch."""
    folder = new_folder(df.sparkSession, "watched")
    query = start_query(df, "parquet", path=f"{folder}/t", checkpoint=f"{folder}/c")
    finish(query)
    held = max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/t"), held


def test_every_start_before_an_end_is_matched(spark, tmp_path):
    random = np.random.default_rng(5)
    events = [(int(i), int(k), int(t)) for i, k, t in zip(random.integers(0, 400, 3000), random.integers(0, 2, 3000), random.integers(0, 300, 3000))]
    frames = [call_events_df(spark, events[:1000]), call_events_df(spark, events[1000:])]
    # Row ids follow the order of arrival within a frame.
    rows = [(i, k, t, n) for part in (events[:1000], events[1000:]) for n, (i, k, t) in enumerate(part)]
    wanted = sorted(
        (i, t, u) for i, k, t, n in rows if k == 0 for j, l, u, m in rows if l == 1 and i == j and t <= u <= t + 20 and (u > t or m > n)
    )
    source = Source(spark, tmp_path, frames)
    found, held = run_watched(streams.match_calls(source.read(), delay="1 hour", max_open_ms=20_000))
    assert sorted((r.unique_id, seconds(r.start_ts), seconds(r.end_ts)) for r in found.collect()) == wanted
    # An entry and a timer per bucket, not one entry or more per event.
    assert held <= 3 * streams.JOIN_BUCKETS < 2000


def test_sessions_joined_by_bucket_equal_the_native_join(spark):
    def pairs(one_call_per_id):
        c = stage_feed(derived.call_events(spark, DATA), gaps.BY_EVENT, slices=3)
        t = stage_feed(derived.tower_events(spark, DATA), gaps.BY_EVENT, slices=3)
        return streams.overlap_of_sessions(
            c.read(spark), t.read(spark), bound_ms=10_000, delay="12 hours", max_open_ms=43_200_000, one_call_per_id=one_call_per_id
        )

    found, held = run_watched(pairs(True))
    native = run_to_table(pairs(False))
    assert reconcile(native, to_zone_free(found)).count() == 0 and native.count() > 100
    assert held <= 3 * streams.JOIN_BUCKETS


@pytest.mark.parametrize(("low", "high"), [(0, 7), (-3, 3), (0, 0)])
def test_near_rows_are_found_in_pieces(low, high):
    random = np.random.default_rng(1)
    n = 500
    both = {"unique_id": random.integers(-2, 3, n), "at_ms": random.integers(-50, 50, n), "is_right": random.random(n) < 0.5}
    join = NearProcessor(["unique_id"], {}, [], low, high)
    join.piece = 40
    left, right = np.flatnonzero(~both["is_right"]), np.flatnonzero(both["is_right"])
    pieces = list(join._found(both, both["unique_id"] + 2, left, right))
    got = sorted(r for p in pieces for r in p.itertuples(index=False, name=None))
    side = lambda rows: [(both["unique_id"][r], both["at_ms"][r]) for r in rows]
    assert got == sorted((i, a, b) for i, a in side(left) for j, b in side(right) if i == j and low <= b - a <= high)
    assert len(pieces) > 1 and max(len(p) for p in pieces) <= max(40, n)


def test_rebuilt_spans_equal_session_windows(spark, tmp_path):
    random = np.random.default_rng(3)
    times = np.sort(random.integers(0, 4000, 3000))
    # Gaps of exactly the longest one belong to a session.
    events = [(int(i), str(t), 0, int(at)) for i, t, at in zip(random.integers(0, 60, 3000), random.integers(0, 2, 3000), times)]
    events += [(100, "a", 0, 4000), (100, "a", 0, 4030), (100, "a", 0, 4061), (101, None, 0, 4061), (None, "a", 0, 4061), (-1, "z", 0, 9000)]
    rows = tower_events_df(spark, events)
    wanted = rows.where("unique_id >= 0").groupBy("unique_id", "tower", F.session_window("ts", "30 seconds").alias("w")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    source = Source(spark, tmp_path, [tower_events_df(spark, part) for part in (events[:1000], events[1000:2000], events[2000:])])
    spans = streams._rebuilt(source.read(), ["tower"], "10 seconds", "30 seconds")
    found, held = run_watched(spans)
    key = lambda r: (r[0], r[1] or "", r[2])
    got = sorted(((r.unique_id, r.tower, r.start_ms / 1000, seconds(r["at"]) - 0.002) for r in found.collect()), key=key)
    day = EPOCH.replace(tzinfo=dt.timezone.utc).timestamp()
    expected = sorted(((r.unique_id, r.tower, day + seconds(r["first"]), seconds(r["last"])) for r in wanted.collect()), key=key)
    assert got == [pytest.approx(e) if e[1] is None else (e[0], e[1], pytest.approx(e[2]), pytest.approx(e[3])) for e in expected]
    assert {e[2] - day for e in expected if e[0] == 100} == {4000, 4061} and len(expected) > 1000
    # An entry and a timer per bucket; the windows had an entry per open session.
    assert held <= 3 * streams.JOIN_BUCKETS


def test_a_session_that_ends_before_the_others_of_its_bucket_is_closed_in_time(spark, tmp_path):
    frames = [[(1, "a", 0, 100)], [(2, "a", 0, 60)], [(3, "a", 0, 125)], [(4, "a", 0, 126)], [(5, "a", 0, 400)], [(6, "a", 0, 900)]]
    source = Source(spark, tmp_path, [tower_events_df(spark, f) for f in frames])
    spans = streams._rebuilt(source.read(), ["tower"], "50 seconds", "10 seconds", buckets=1)
    assert sorted(r.unique_id for r in run_to_table(spans).collect()) == [1, 2, 3, 4, 5]


def test_overlap_of_rebuilt_equals_the_batch_form(spark):
    calls, towers = derived.call_events(spark, DATA), derived.tower_events(spark, DATA)
    longest = 12 * 3_600_000
    c = stage_feed(calls, gaps.BY_EVENT, slices=4, close_after_ms=5 * longest)
    t = stage_feed(towers, gaps.BY_EVENT, slices=4, close_after_ms=5 * longest)
    pairs = streams.overlap_of_rebuilt(c.read(spark), t.read(spark), delay="12 hours", max_span="12 hours", bound_ms=longest)
    found, held = run_watched(pairs)
    batch = partial_overlap(rebuild_spans(calls, ["unique_id"]), rebuild_spans(towers, ["unique_id", "tower"]), tolerance_ms=3000)
    assert reconcile(batch, to_zone_free(found)).count() == 0 and batch.count() > 100
    assert held <= 3 * streams.JOIN_BUCKETS
