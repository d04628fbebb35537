from __future__ import annotations

from spanweave.operators.compare import reconcile
from spanweave.operators.keyed import HotKeyPolicy
from spanweave.operators.sessions import pair_calls, pair_towers, rebuild_spans, span_to_events
from spanweave.sources import derived
from tests.conftest import DATA, call_events_df, seconds, tower_events_df, towers_df


def spans(df):
    return sorted((r.tower, seconds(r.start_ts), seconds(r.end_ts)) for r in df.collect())


def test_second_start_replaces_the_first(spark):
    events = tower_events_df(spark, [(1, "A", 0, 0), (1, "B", 0, 2), (1, "B", 1, 5)])
    assert spans(pair_towers(events)) == [("B", 2, 5)]


def test_end_without_start_is_ignored(spark):
    events = tower_events_df(spark, [(1, "A", 1, 0), (1, "A", 0, 1), (1, "A", 1, 2), (1, "A", 1, 3)])
    assert spans(pair_towers(events)) == [("A", 1, 2)]


def test_other_event_types_do_not_count(spark):
    events = tower_events_df(spark, [(1, "A", 0, 0), (1, "A", 7, 1), (1, "A", None, 1), (1, "A", 1, 2)])
    assert spans(pair_towers(events)) == [("A", 0, 2)]


def test_repeat_visit(spark):
    events = tower_events_df(spark, [(1, "A", 0, 0), (1, "A", 1, 1), (1, "A", 0, 5), (1, "A", 1, 6)])
    assert spans(pair_towers(events)) == [("A", 0, 1), ("A", 5, 6)]
    assert spans(rebuild_spans(events, ["unique_id", "tower"])) == [("A", 0, 6)]


def test_ties_follow_arrival(spark):
    events = tower_events_df(spark, [(1, "A", 0, 0), (1, "A", 1, 5), (1, "B", 0, 5), (1, "B", 1, 5)])
    assert spans(pair_towers(events)) == [("A", 0, 5), ("B", 5, 5)]


def test_max_open(spark):
    events = tower_events_df(spark, [(1, "A", 0, 0), (1, "A", 1, 5), (2, "A", 0, 0), (2, "A", 1, 6)])
    assert spans(pair_towers(events, max_open_ms=5000)) == [("A", 0, 5)]


def test_call_columns_come_from_the_end(spark):
    events = call_events_df(spark, [(1, 0, 0, "first"), (1, 1, 4, "second")])
    row = pair_calls(events).first()
    assert (row.caller, seconds(row.start_ts), seconds(row.end_ts), row.imei) == ("second", 0, 4, 1)


def test_round_trip(spark):
    towers = derived.towers(spark, DATA).select("unique_id", "tower", "start_ts", "end_ts")
    back = pair_towers(span_to_events(derived.towers(spark, DATA)))
    assert reconcile(towers, back).count() == 0


def test_split_keys_pair_alike(spark):
    rows = []
    for n in range(300):
        rows += [(7, f"T{n}", 0, n * 10), (7, f"T{n}", 1, n * 10 + 4)]
        rows += [(n, "x", 0, n), (n, "x", 1, n + 1)] if n != 7 else []
    events = tower_events_df(spark, rows)
    split = pair_towers(events, policy=HotKeyPolicy(rows_per_task=50))
    assert split.count() == 599
    assert reconcile(pair_towers(events, policy=None), split).count() == 0


def test_reconcile_counts_copies(spark):
    a = towers_df(spark, [(1, "A", 0, 1)] * 3 + [(2, "B", 0, 1)]).select("unique_id", "tower")
    b = towers_df(spark, [(1, "A", 0, 1), (3, "C", 0, 1)]).select("unique_id", "tower")
    found = {(r.side, r.unique_id): r.copies for r in reconcile(a, b).collect()}
    assert found == {("left", 1): 2, ("left", 2): 1, ("right", 3): 1}
    assert reconcile(a, a).count() == 0
