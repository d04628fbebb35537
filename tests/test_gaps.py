from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import gaps
from spanweave.operators.compare import reconcile
from spanweave.operators.keyed import HotKeyPolicy, carry_after, find_hot_keys, with_previous
from spanweave.operators.sessions import span_to_events
from tests.conftest import call_events_df, calls_df, seconds

TINY = HotKeyPolicy(rows_per_task=40)


def pairs(df, start="next_start", end="prev_end"):
    return sorted((seconds(r[end]), seconds(r[start])) for r in df.collect())


def all_variants(spark, rows):
    calls = calls_df(spark, rows)
    events = span_to_events(calls)
    return {
        "lag": pairs(gaps.gap_lag(calls), "start_ts", "prev_end_ts"),
        "running_max": pairs(gaps.gap_running_max(calls)),
        "pattern": pairs(gaps.gap_pattern(calls), "next_start_timestamp", "prev_end_timestamp"),
        "adjacent": pairs(gaps.gap_events_adjacent(events), "next_start_timestamp", "prev_end_timestamp"),
        "last_end": pairs(gaps.gap_events_last_end(events)),
    }


def test_nested_and_overlapping_calls(spark):
    found = all_variants(spark, [(1, 0, 2), (2, 1, 10), (3, 3, 12)])
    assert found == {"lag": [], "running_max": [], "pattern": [], "adjacent": [(2, 3)], "last_end": [(2, 3)]}


def test_long_call_hides_gap_only_from_running_max(spark):
    found = all_variants(spark, [(1, 0, 10), (2, 1, 2), (3, 5, 6)])
    assert found["lag"] == found["pattern"] == [(2, 5)]
    assert found["running_max"] == []


def test_busy_call_between_breaks_the_pattern(spark):
    rows = [(1, 0, 1, "a", "connected"), (2, 2, 2, "a", "busy"), (3, 4, 5, "a", "connected")]
    found = all_variants(spark, rows)
    assert found["lag"] == found["running_max"] == found["adjacent"] == [(1, 4)]
    assert found["pattern"] == []
    assert found["last_end"] == [(1, 2), (2, 4)]


def test_zero_gap_gives_no_row(spark):
    assert not any(all_variants(spark, [(1, 0, 2), (2, 2, 3)]).values())


def test_first_call_and_other_callers_give_no_row(spark):
    assert not any(all_variants(spark, [(1, 0, 2, "a"), (2, 5, 6, "b")]).values())


def test_two_starts_after_one_end_both_count(spark):
    events = call_events_df(spark, [(1, 0, 0), (1, 1, 1), (2, 0, 3), (3, 0, 5)])
    assert pairs(gaps.gap_events_last_end(events)) == [(1, 3), (1, 5)]
    assert pairs(gaps.gap_events_adjacent(events), "next_start_timestamp", "prev_end_timestamp") == [(1, 3)]


def test_units(spark):
    row = gaps.gap_lag(calls_df(spark, [(1, 0, 0.9), (2, 2.1, 3)])).first()
    assert (row.gap_ms, row.gap_seconds, row.gap_duration.total_seconds()) == (1200, 1, 1.2)


def test_clamped(spark):
    rows = gaps.gap_clamped(calls_df(spark, [(1, 0, 5), (2, 3, 4), (3, 7, 8)])).collect()
    assert sorted(r.gap_ms for r in rows) == [0, 2000]


def test_ttl(spark):
    calls = calls_df(spark, [(1, 0, 1), (2, 3, 4), (3, 100, 101)])
    assert pairs(gaps.gap_running_max(calls, ttl_ms=2000)) == [(1, 3)]
    assert pairs(gaps.gap_running_max(calls, ttl_ms=1999)) == []


def test_sorted_report(spark):
    calls = calls_df(spark, [(1, 9, 10, "b"), (2, 20, 21, "b"), (3, 0, 1, "a"), (4, 30, 31, "a")])
    assert [r.caller for r in gaps.in_time_order(gaps.gap_lag(calls)).collect()] == ["a", "b"]
    assert [r.caller for r in gaps.in_time_order(gaps.gap_lag(calls), by_caller=False).collect()] == ["b", "a"]


def skewed(spark, seed=1):
    """One caller and the missing caller hold most rows; some rows are exact copies."""
    rng = random.Random(seed)
    rows = []
    for uid in range(600):
        caller = rng.choice(["hot", "hot", None, f"c{uid % 20}"])
        start = rng.choice([rng.random() * 1000, rng.randrange(40)])
        kind = rng.choice(["connected", "connected", "busy"])
        rows.append((uid, round(start, 3), round(start + (rng.random() * 20 if kind == "connected" else 0), 3), caller, kind))
    rows += [(1000, 500.0, 501.0, "copies", "connected")] * 120
    return calls_df(spark, rows)


def same(a, b):
    return reconcile(a, b).count() == 0 and a.count() > 0


def test_hot_keys_are_found(spark):
    hot = find_hot_keys(skewed(spark), "caller", TINY)
    assert {r.caller for r in hot.listed.collect()} == {"hot", None, "copies"} and hot.keys == 3
    assert not find_hot_keys(skewed(spark), "caller")


@pytest.mark.parametrize("variant", ["gap_lag", "gap_running_max", "gap_pattern", "gap_clamped"])
def test_split_keys_give_the_same_rows(spark, variant):
    calls = skewed(spark)
    op = getattr(gaps, variant)
    assert same(op(calls, policy=None), op(calls, policy=TINY))


@pytest.mark.parametrize("variant", ["gap_events_adjacent", "gap_events_last_end"])
def test_split_keys_give_the_same_rows_from_events(spark, variant):
    # Distinct times: copies of one call would make the order of their events ambiguous.
    events = span_to_events(skewed(spark).dropDuplicates(["unique_id"]))
    op = getattr(gaps, variant)
    assert same(op(events, policy=None), op(events, policy=TINY))


def test_copies_are_cut_into_several_runs(spark):
    calls = calls_df(spark, [(1, 5, 6)] * 200)
    before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would merge small partitions again
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = with_previous(calls, "caller", gaps.BY_START, F.col("end_ts"), latest=True, policy=TINY)
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(tasks) >= 3
    assert max(t["count"] for t in tasks) <= 120
    assert found.where("prev is null").count() == 1
    assert found.count() == 200


@pytest.mark.parametrize("latest", [True, False])
@pytest.mark.parametrize("policy", [None, TINY])
def test_chained_batches_equal_one_batch(spark, latest, policy):
    calls = skewed(spark).where("caller is not null").dropDuplicates(["unique_id"])
    op = gaps.gap_lag if latest else gaps.gap_running_max
    cut = F.col("start_ts") < "2024-01-01 00:00:30"
    first, second = calls.where(cut), calls.where(~cut)
    connected = first.where("disposition = 'connected'")
    seed = carry_after(connected, "caller", gaps.BY_START, F.col("end_ts"), latest=latest)
    chained = op(first, policy=policy).unionByName(op(second, seed=seed, policy=policy))
    assert same(op(calls, policy=None), chained)


def test_carry_goes_on_over_batches_without_the_key(spark):
    one = calls_df(spark, [(1, 0, 5, "a"), (2, 0, 9, "b")])
    two = calls_df(spark, [(3, 10, 11, "b")])
    for latest in (True, False):
        seed = carry_after(one, "caller", gaps.BY_START, F.col("end_ts"), latest=latest)
        seed = carry_after(two, "caller", gaps.BY_START, F.col("end_ts"), latest=latest, seed=seed)
        assert {r.caller: seconds(r.carried) for r in seed.collect()} == {"a": 5, "b": 11}
