from __future__ import annotations

import random

import pytest

from spanweave.operators.keyed import HotKeyPolicy
from spanweave.operators.overlap import bounded_overlap, partial_overlap
from spanweave.operators.sessions import pair_towers, rebuild_spans, span_to_events
from tests.conftest import calls_df, towers_df

CALL = [(1, 10, 20)]


def hits(spark, towers, calls=CALL, **options):
    found = partial_overlap(calls_df(spark, calls), towers_df(spark, towers), **options)
    return sorted(r.tower for r in found.collect())


@pytest.mark.parametrize(
    ("span", "strict", "tolerant"),
    [
        ((5, 10), False, True),  # ends where the call starts
        ((20, 25), False, True),  # starts where the call ends
        ((10, 20), False, False),  # equal
        ((12, 18), False, False),  # inside
        ((10, 15), False, False),  # inside, same start
        ((5, 25), True, True),  # around
        ((5, 15), True, True),  # over the start
        ((15, 25), True, True),  # over the end
        ((10, 25), True, True),  # same start, longer
        ((20.5, 22), False, True),  # just after
        ((22.999, 24), False, True),
        ((23, 24), False, False),  # the tolerance is exclusive
        ((7, 7), False, False),
        ((7.001, 7.001), False, True),
        ((22, 8), False, False),  # inverted
        ((15, 14), False, False),  # inverted, inside
        ((21, 19), False, False),  # inverted over the end: counted as inside
    ],
)
def test_edges(spark, span, strict, tolerant):
    towers = [(1, "T", *span)]
    for policy in (None, HotKeyPolicy(rows_per_task=0)):
        assert bool(hits(spark, towers, policy=policy)) == strict
        assert bool(hits(spark, towers, tolerance_ms=3000, policy=policy)) == tolerant


def test_call_of_length_zero(spark):
    towers = [(1, "from", 10, 12), (1, "over", 9, 11)]
    call = [(1, 10, 10)]
    assert hits(spark, towers, call) == ["over"]
    assert hits(spark, towers, call, tolerance_ms=3000) == ["from", "over"]


def test_other_ids_nulls_and_disposition(spark):
    calls = [(1, 10, 20, "a", "busy"), (2, 10, None, "a"), (None, 10, 20, "a")]
    towers = [(1, "x", 5, 15), (2, "y", 5, 15), (None, "z", 5, 15), (3, "w", 5, 15)]
    assert hits(spark, towers, calls) == ["x"]
    assert hits(spark, towers, calls, connected_only=True) == []


def test_bounds_are_inclusive(spark):
    towers = [(1, "a", 5, 20), (1, "b", 15, 30), (1, "c", 15, 30.001), (1, "d", 5, 10.5), (1, "e", 5, 9.999)]
    calls = calls_df(spark, CALL)
    found = bounded_overlap(calls, towers_df(spark, towers), bound_ms=10_000)
    assert sorted(r.tower for r in found.collect()) == ["a", "b", "d"]


def brute(calls, towers, tolerance=0, bound=None):
    out = []
    for c in calls:
        for t in towers:
            if c[0] != t[0]:
                continue
            meets = t[2] < c[2] + tolerance and t[3] > c[1] - tolerance
            inside = t[2] >= c[1] and t[3] <= c[2]
            close = bound is None or abs(t[3] - c[2]) <= bound
            if meets and not inside and close:
                out.append((c[0], t[1], c[1], c[2], t[2], t[3]))
    return sorted(out)


def random_spans(seed):
    """Few ids, repeated on both sides, with spans from nothing to very long."""
    rng = random.Random(seed)

    def span():
        start = rng.randrange(0, 2_000)
        length = rng.choice([0, 1, rng.randrange(50), rng.randrange(2_000), -rng.randrange(1, 30)])
        return start, start + length

    calls = [(rng.choice([1, 1, 1, 2, 3]), *(s := span())) for _ in range(60)]
    calls = [(i, s, max(s, e)) for i, s, e in calls]
    towers = [(rng.choice([1, 1, 1, 2, 4]), f"T{n}", *span()) for n in range(80)]
    return calls, towers


def as_tuples(df):
    from tests.conftest import seconds

    return sorted(
        (r.unique_id, r.tower, *(int(seconds(r[c])) for c in ("call_start", "call_end", "tower_start", "tower_end")))
        for r in df.collect()
    )


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("tolerance", [0, 3])
@pytest.mark.parametrize("rows_per_task", [None, 0, 20])
def test_same_pairs_with_and_without_time_cells(spark, seed, tolerance, rows_per_task):
    calls, towers = random_spans(seed)
    policy = None if rows_per_task is None else HotKeyPolicy(rows_per_task=rows_per_task)
    found = partial_overlap(
        calls_df(spark, calls), towers_df(spark, towers), tolerance_ms=tolerance * 1000, policy=policy
    )
    assert as_tuples(found) == brute(calls, towers, tolerance)


@pytest.mark.parametrize("bound", [1, 30])
def test_bounded_pairs(spark, bound):
    calls, towers = random_spans(3)
    found = bounded_overlap(calls_df(spark, calls), towers_df(spark, towers), bound_ms=bound * 1000)
    assert as_tuples(found) == brute(calls, towers, bound=bound)


def test_inverted_span_turns_positive_only_in_minmax(spark):
    events = span_to_events(towers_df(spark, [(1, "T", 25, 15)]))
    calls = calls_df(spark, CALL)
    assert pair_towers(events).count() == 0
    rebuilt = rebuild_spans(events, ["unique_id", "tower"])
    assert partial_overlap(calls, rebuilt).count() == 1
