"""Gaps between consecutive spans of the same caller.

The functions differ in what "the previous call" means and in which calls count; they give
different results on the same data. All are one look-back within a caller (see ``keyed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.predicates import is_connected, is_end, is_start
from spanweave.functions.times import clamped_gap_ms, gap_interval, gap_ms, gap_seconds
from spanweave.operators.keyed import DEFAULT_POLICY, HotKeyPolicy, with_previous
from spanweave.schemas import CONNECTED

BY_START = ["start_ts", "unique_id"]
BY_EVENT = ["ts", "row_id"]


def _calls(calls: DataFrame, connected_only: bool, *columns: str) -> DataFrame:
    rows = calls.where(is_connected()) if connected_only else calls
    # As on streams: a call without a start or an end takes no part.
    rows = rows.where(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
    return rows.select("caller", "unique_id", "start_ts", "end_ts", *columns)


def _within(ttl_ms: int | None, earlier: Column | str, later: Column | str) -> Column:
    return F.lit(True) if ttl_ms is None else gap_ms(earlier, later) <= ttl_ms


def gap_lag(
    calls: DataFrame,
    *,
    connected_only: bool = True,
    ttl_ms: int | None = None,
    seed: DataFrame | None = None,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Gap to the end of the call that started just before."""
    rows = with_previous(
        _calls(calls, connected_only), "caller", BY_START, F.col("end_ts"), latest=True, seed=seed, policy=policy
    )
    return rows.where((F.col("start_ts") > F.col("prev")) & _within(ttl_ms, "prev", "start_ts")).select(
        "caller",
        "unique_id",
        "start_ts",
        "end_ts",
        F.col("prev").alias("prev_end_ts"),
        gap_interval("prev", "start_ts").alias("gap_duration"),
        gap_ms("prev", "start_ts").alias("gap_ms"),
        gap_seconds("prev", "start_ts").alias("gap_seconds"),
    )


def gap_running_max(
    calls: DataFrame,
    *,
    connected_only: bool = True,
    ttl_ms: int | None = None,
    seed: DataFrame | None = None,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Gap to the latest end among all calls that started before."""
    rows = _after_latest_end(calls, connected_only, seed, policy)
    return _gaps(rows.where((F.col("start_ts") > F.col("prev")) & _within(ttl_ms, "prev", "start_ts")), "start_ts")


def gap_clamped(
    calls: DataFrame, *, connected_only: bool = True, policy: HotKeyPolicy | None = DEFAULT_POLICY
) -> DataFrame:
    """As ``gap_running_max`` for every call with a predecessor; overlapping calls get gap 0."""
    return (
        _after_latest_end(calls, connected_only, None, policy)
        .where(F.col("prev").isNotNull())
        .select(
            "caller",
            F.col("prev").alias("prev_end"),
            F.col("start_ts").alias("next_start"),
            clamped_gap_ms("prev", "start_ts").alias("gap_ms"),
        )
    )


def gap_pattern(
    calls: DataFrame,
    *,
    ttl_ms: int | None = None,
    seed: DataFrame | None = None,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Two connected calls with no other call of any disposition starting in between."""
    carry = F.struct("end_ts", "disposition")
    rows = with_previous(
        _calls(calls, False, "disposition"), "caller", BY_START, carry, latest=True, seed=seed, policy=policy
    )
    end = F.col("prev.end_ts")
    both = is_connected() & (F.col("prev.disposition") == CONNECTED)
    return _gap_seconds(rows.where(both & (F.col("start_ts") > end) & _within(ttl_ms, end, "start_ts")), end, "start_ts")


def gap_events_adjacent(
    events: DataFrame,
    *,
    connected_only: bool = True,
    ttl_ms: int | None = None,
    seed: DataFrame | None = None,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Each START that directly follows an END among the caller's events."""
    rows = events.where(is_connected()) if connected_only else events
    rows = with_previous(
        rows.select("caller", "event_type", *BY_EVENT),
        "caller",
        BY_EVENT,
        F.struct("event_type", "ts"),
        latest=True,
        seed=seed,
        policy=policy,
    )
    end = F.col("prev.ts")
    follows = is_start() & is_end("prev.event_type")
    return _gap_seconds(rows.where(follows & (F.col("ts") > end) & _within(ttl_ms, end, "ts")), end, "ts")


def gap_events_last_end(
    events: DataFrame,
    *,
    connected_only: bool = False,
    ttl_ms: int | None = None,
    seed: DataFrame | None = None,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Each START and the latest END before it, whatever lies between them."""
    rows = events.where(is_connected()) if connected_only else events
    rows = with_previous(
        rows.select("caller", "event_type", *BY_EVENT),
        "caller",
        BY_EVENT,
        last_end_carry(),
        latest=False,
        seed=seed,
        policy=policy,
    )
    return _gaps(rows.where(is_start() & (F.col("ts") > F.col("prev")) & _within(ttl_ms, "prev", "ts")), "ts")


def last_end_carry() -> Column:
    """In time order the latest END seen so far is also the greatest."""
    return F.when(is_end(), F.col("ts"))


def in_time_order(gaps: DataFrame, start: str = "start_ts", by_caller: bool = True) -> DataFrame:
    """Sort a result by caller and start, or by start alone. For reports, not for pipelines:
    it adds a range shuffle."""
    return gaps.orderBy("caller", start) if by_caller else gaps.orderBy(start)


def _after_latest_end(calls, connected_only, seed, policy) -> DataFrame:
    return with_previous(
        _calls(calls, connected_only), "caller", BY_START, F.col("end_ts"), latest=False, seed=seed, policy=policy
    )


def _gaps(rows: DataFrame, start: str) -> DataFrame:
    return rows.select(
        "caller",
        F.col("prev").alias("prev_end"),
        F.col(start).alias("next_start"),
        gap_ms("prev", start).alias("gap_ms"),
    )


def _gap_seconds(rows: DataFrame, end: Column, start: str) -> DataFrame:
    return rows.select(
        "caller",
        end.alias("prev_end_timestamp"),
        F.col(start).alias("next_start_timestamp"),
        gap_seconds(end, start).alias("time_gap_seconds"),
    )
