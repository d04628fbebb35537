"""Tower spans that overlap a call without being contained in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.predicates import is_connected, near, partly_overlaps
from spanweave.functions.times import millis
from spanweave.operators.keyed import HotKeyPolicy, find_hot_keys

# A join group of one id is quadratic if the id repeats on both sides, so ids count as hot
# far earlier here than where a group is only sorted.
JOIN_POLICY = HotKeyPolicy(rows_per_task=200_000)


def partial_overlap(
    calls: DataFrame,
    towers: DataFrame,
    *,
    tolerance_ms: int = 0,
    connected_only: bool = False,
    policy: HotKeyPolicy | None = JOIN_POLICY,
) -> DataFrame:
    """Partly overlapping (call, tower) pairs of the same ``unique_id``.

    One equi-join with the time predicate as its residual condition. Ids that hold very many
    rows are joined on time cells as well (``_by_time_cell``), so that neither one task nor
    all pairs of the id have to be worked through. ``policy=None`` skips the search for hot
    ids, for inputs known to have few rows per id. ``tolerance_ms`` widens the call.
    """
    c, t = _sides(calls, towers, connected_only)
    match = _match(tolerance_ms)
    hot = None
    if policy is not None:
        hot = find_hot_keys(c.select("unique_id").unionByName(t.select("unique_id")), "unique_id", policy)
    if not hot:
        return _tidy(c.join(t, "unique_id").where(match))
    c, c_hot = hot.split(c)
    t, t_hot = hot.split(t)
    return _tidy(c.join(t, "unique_id").where(match)).unionByName(
        _tidy(_by_time_cell(c_hot, t_hot, tolerance_ms, match))
    )


def bounded_overlap(
    calls: DataFrame,
    towers: DataFrame,
    *,
    bound_ms: int,
    tolerance_ms: int = 0,
    connected_only: bool = False,
    delay: str | None = None,
) -> DataFrame:
    """As ``partial_overlap``, for towers that end within ``bound_ms`` of the call's end.

    Works on batch and on streams. The bound makes a band join: next to the id, both sides
    match on a cell of end time, ten bounds wide. A call falls into one cell, or two if it
    ends close to a border (1.2 on average), a tower into exactly one. So a hot id is spread
    over time. On streams ``delay`` sets the watermark on both end times, from which the
    bound limits the join state; lateness and bound are separate.
    """
    if delay is not None:
        calls, towers = calls.withWatermark("end_ts", delay), towers.withWatermark("end_ts", delay)
    return _tidy(_band(*_sides(calls, towers, connected_only), "end", bound_ms).where(_match(tolerance_ms)))


def overlap_by_start(
    calls: DataFrame,
    towers: DataFrame,
    *,
    longest_ms: int,
    tolerance_ms: int = 0,
    connected_only: bool = False,
    call_delay: str | None = None,
    tower_delay: str | None = None,
) -> DataFrame:
    """As ``partial_overlap``, for spans no longer than ``longest_ms``, by their starts.

    Works on batch and on streams. Spans that overlap begin at most their longest length, and
    the tolerance, apart: that is a band join on the starts, from which a stream knows how long to keep its
    rows. The delays set a watermark on each side's start; calls and towers may differ. Longer
    spans are left out, so that the result does not depend on how rows fall into batches.
    """
    short = F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {int(longest_ms)} MILLISECONDS")
    calls, towers = calls.where(short), towers.where(short)
    if call_delay is not None:
        calls = calls.withWatermark("start_ts", call_delay)
    if tower_delay is not None:
        towers = towers.withWatermark("start_ts", tower_delay)
    joined = _band(*_sides(calls, towers, connected_only), "start", longest_ms + tolerance_ms)
    return _tidy(joined.where(_match(tolerance_ms)))


def _band(c: DataFrame, t: DataFrame, side: str, bound_ms: int) -> DataFrame:
    """Pairs of one id whose starts or ends lie within the bound, joined on (id, cell of that time)."""
    c = c.withColumn("_cell", F.explode(_cells(f"call_{side}", bound_ms)))
    t = t.withColumn("_cell", _cell(f"tower_{side}", bound_ms))
    return c.join(t, ["unique_id", "_cell"]).where(near(f"tower_{side}", f"call_{side}", bound_ms))


def end_cells(calls: DataFrame, towers: DataFrame, end: str, bound_ms: int) -> tuple[DataFrame, DataFrame]:
    """Calls and towers with ``_cell``, in which those meet whose ends lie within the bound."""
    return calls.withColumn("_cell", F.explode(_cells(end, bound_ms))), towers.withColumn("_cell", _cell(end, bound_ms))


def _cells(time: str, bound_ms: int) -> Column:
    width, at = max(1, 10 * bound_ms), millis(time)
    return F.sequence(_floor_div(at - bound_ms, width), _floor_div(at + bound_ms, width))


def _cell(time: str, bound_ms: int) -> Column:
    return _floor_div(millis(time), max(1, 10 * bound_ms))


def _sides(calls: DataFrame, towers: DataFrame, connected_only: bool) -> tuple[DataFrame, DataFrame]:
    if connected_only:
        calls = calls.where(is_connected())
    names = [n for n in ("caller",) if n in calls.columns]
    c = calls.select("unique_id", *names, F.col("start_ts").alias("call_start"), F.col("end_ts").alias("call_end"))
    t = towers.select("unique_id", "tower", F.col("start_ts").alias("tower_start"), F.col("end_ts").alias("tower_end"))
    return c, t


def _match(tolerance_ms: int) -> Column:
    return partly_overlaps("tower_start", "tower_end", "call_start", "call_end", tolerance_ms)


def _tidy(joined: DataFrame) -> DataFrame:
    names = [n for n in ("caller",) if n in joined.columns]
    return joined.select("unique_id", *names, "tower", "call_start", "call_end", "tower_start", "tower_end")


def _floor_div(value: Column, by: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def _by_time_cell(c: DataFrame, t: DataFrame, tolerance_ms: int, match: Column) -> DataFrame:
    """The same pairs, found through the points in time at which calls start and end.

    A tower that partly overlaps a call sticks out at one end, so the tower (widened by the
    tolerance) covers the call's start or its end. Each widened tower is filed at the level
    whose cells are just longer than itself, where it touches at most two cells; each point
    looks into the one cell that contains it at every level in use for the id (64 at most).
    Points and towers of an id meet only if they are close in time.
    """
    lo = millis("tower_start") - tolerance_ms
    hi = millis("tower_end") + tolerance_ms
    t = (
        t.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .where(F.col("_hi") >= F.col("_lo"))
        .withColumn("_level", F.length(F.bin(F.col("_hi") - F.col("_lo"))))
    )
    levels = t.groupBy("unique_id").agg(F.collect_set("_level").alias("_levels"))
    t = t.withColumn(
        "_cell",
        F.explode(F.expr("array_distinct(array(shiftright(_lo, _level), shiftright(_hi, _level)))")),
    )
    at_end = F.explode(F.array(F.lit(False), F.lit(True)))
    points = (
        c.withColumn("_from", millis("call_start"))
        .withColumn("_at_end", at_end)
        .withColumn("_point", F.when(F.col("_at_end"), millis("call_end")).otherwise(F.col("_from")))
        .join(levels, "unique_id")
        .withColumn("_level", F.explode("_levels"))
        .withColumn("_cell", F.expr("shiftright(_point, _level)"))
        .drop("_levels")
    )
    covers = F.col("_point").between(F.col("_lo"), F.col("_hi"))
    # A pair found through the start of the call is not taken again through its end.
    once = ~F.col("_at_end") | ~F.col("_from").between(F.col("_lo"), F.col("_hi"))
    return points.join(t, ["unique_id", "_level", "_cell"]).where(covers & once & match)
