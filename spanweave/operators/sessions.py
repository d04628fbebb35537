"""Conversions between spans and their START and END events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.predicates import is_end, is_start
from spanweave.functions.times import gap_ms
from spanweave.operators.keyed import DEFAULT_POLICY, HotKeyPolicy, carry_after, with_previous
from spanweave.schemas import END, START

# Columns that a call takes from its END event and a tower visit from its START event.
CALL_FIELDS = ("caller", "callee", "imei")
TOWER_FIELDS = ("tower",)

_ORDER = ["ts", "row_id"]


def span_to_events(spans: DataFrame) -> DataFrame:
    """Two rows per span: ``event_type``, ``ts`` and a doubled ``row_id`` replace the times.

    All other columns are kept on both rows. Narrow: no shuffle.
    """
    kept = [c for c in spans.columns if c not in ("start_ts", "end_ts", "row_id")]
    sides = F.array(
        F.struct(F.lit(START).alias("event_type"), F.col("start_ts").alias("ts")),
        F.struct(F.lit(END).alias("event_type"), F.col("end_ts").alias("ts")),
    )
    return spans.withColumn("_e", F.explode(sides)).select(
        *kept,
        F.col("_e.event_type").alias("event_type"),
        F.col("_e.ts").alias("ts"),
        (F.col("row_id") * 2 + F.col("_e.event_type")).alias("row_id"),
    )


def rebuild_spans(events: DataFrame, keys: list[str]) -> DataFrame:
    """One span per key from its first to its last event.

    With a tower among the keys, repeat visits to the tower merge into one span. Minimum and
    maximum combine before the shuffle, so a hot key costs one row per map task.
    """
    return events.groupBy(*keys).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def pair_spans(
    events: DataFrame,
    *,
    key: str = "unique_id",
    from_start: tuple[str, ...] = (),
    from_end: tuple[str, ...] = (),
    max_open_ms: int | None = None,
    seed: DataFrame | None = None,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Each END whose preceding event of the same key is a START, as a span.

    A second START replaces the first, an END without a START is ignored, repeat visits stay
    apart. ``from_start`` and ``from_end`` name columns taken from either event.
    ``max_open_ms`` leaves out longer spans (as the streaming form, which forgets them).
    ``seed`` holds the events left open by earlier rows, see ``open_spans``.
    """
    rows = events.where((is_start() | is_end()) & F.col(key).isNotNull() & F.col("ts").isNotNull()).select(
        key, "event_type", "ts", "row_id", *dict.fromkeys((*from_start, *from_end))
    )
    rows = with_previous(rows, key, _ORDER, _last_event(from_start), latest=True, seed=seed, policy=policy)
    rows = rows.where(is_end() & is_start("prev.event_type"))
    if max_open_ms is not None:
        rows = rows.where(gap_ms("prev.ts", "ts") <= max_open_ms)
    return rows.select(
        key,
        *(F.col(f"prev.{c}").alias(c) for c in from_start),
        F.col("prev.ts").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        *from_end,
    )


def open_spans(
    events: DataFrame,
    *,
    key: str = "unique_id",
    from_start: tuple[str, ...] = (),
    seed: DataFrame | None = None,
) -> DataFrame:
    """The keys whose last event is a START, as a ``seed`` for the events that follow."""
    rows = events.where((is_start() | is_end()) & F.col(key).isNotNull() & F.col("ts").isNotNull())
    ends = carry_after(rows, key, _ORDER, _last_event(from_start), latest=True, seed=seed)
    return ends.where(is_start("carried.event_type"))


def _last_event(from_start: tuple[str, ...]) -> Column:
    return F.struct("event_type", "ts", *from_start)


def pair_calls(events: DataFrame, **options) -> DataFrame:
    """Call spans from call events; caller, callee and imei come from the END event."""
    return pair_spans(events, from_end=CALL_FIELDS, **options)


def pair_towers(events: DataFrame, **options) -> DataFrame:
    """Tower spans from tower events, one open visit per call; the START names the tower."""
    return pair_spans(events, from_start=TOWER_FIELDS, **options)
