"""The named queries, each a function of a session and a folder with the input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave import schemas
from spanweave.functions.predicates import is_connected
from spanweave.functions.times import millis
from spanweave.operators import compare, gaps, overlap, sessions
from spanweave.plans import sql_text
from spanweave.schemas import conform, to_zone_free
from spanweave.session import new_folder, prepare_session
from spanweave.sources import derived, signals, tables
from spanweave.streaming import carried, operators as streams
from spanweave.streaming.feeds import Feed, extend_feed, stage_feed, stage_slices
from spanweave.streaming.metrics import BatchMetrics
from spanweave.streaming.run import finish, run_to_table, start_query
from spanweave.streaming.unbounded import overlap_unbounded

Query = Callable[[SparkSession, str], DataFrame]

TOLERANCE_MS = 3_000
BOUND_MS = 10_000
# Feeds are ordered by their event time; only rows of one and the same time may be late.
FEED_DELAY = "1 second"

# Micro-batches in which a replayed table arrives, at least.
SLICES = 8

_CATALOG: dict[str, Query] = {}


def catalog() -> dict[str, Query]:
    return dict(_CATALOG)


def _query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(prepare_session(spark), folder)

    run.__doc__ = build.__doc__
    _CATALOG[build.__name__] = run
    return run


# --- result layouts -----------------------------------------------------------------


def _by_call_id(pairs: DataFrame) -> DataFrame:
    return conform(pairs.withColumnRenamed("unique_id", "call_id"), schemas.OVERLAP_BY_ID)


def _tower_only(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "unique_id",
        "tower",
        F.col("tower_start").alias("tower_start_ts"),
        F.col("tower_end").alias("tower_end_ts"),
    )


def _session_names(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("unique_id").alias("CallID"),
        F.col("tower").alias("Tower"),
        F.col("tower_start").alias("TowerStart"),
        F.col("tower_end").alias("TowerEnd"),
    )


# --- batch --------------------------------------------------------------------------


@_query
def connected_calls(spark, folder):
    calls = derived.calls(spark, folder).where(is_connected())
    return calls.select("caller", F.col("start_ts").alias("call_start_ts"), F.col("end_ts").alias("call_end_ts"))


@_query
def q2_overlap(spark, folder):
    return overlap.partial_overlap(derived.calls(spark, folder), derived.towers(spark, folder))


@_query
def q2_overlap_sql(spark, folder):
    """The same question as SQL text over a registered view."""
    sql_text.offer_overlaps(spark, derived.calls(spark, folder), derived.towers(spark, folder))
    return spark.sql(sql_text.PARTIAL_OVERLAP)


@_query
def q2_overlap_tolerant(spark, folder):
    pairs = overlap.partial_overlap(
        derived.calls(spark, folder), derived.towers(spark, folder), tolerance_ms=TOLERANCE_MS
    )
    return _by_call_id(pairs)


@_query
def q2_overlap_bounded(spark, folder):
    pairs = overlap.bounded_overlap(
        derived.calls(spark, folder), derived.towers(spark, folder), bound_ms=BOUND_MS, connected_only=True
    )
    return _tower_only(pairs)


@_query
def q2_overlap_events_minmax(spark, folder):
    calls = sessions.rebuild_spans(derived.call_events(spark, folder), ["unique_id"])
    towers = sessions.rebuild_spans(derived.tower_events(spark, folder), ["unique_id", "tower"])
    # One call row per id after the aggregation, so no id can be hot on both sides.
    return _by_call_id(overlap.partial_overlap(calls, towers, tolerance_ms=TOLERANCE_MS, policy=None))


@_query
def q2_overlap_events_sessions(spark, folder):
    calls = sessions.pair_calls(derived.call_events(spark, folder))
    towers = sessions.pair_towers(derived.tower_events(spark, folder))
    return _session_names(overlap.bounded_overlap(calls, towers, bound_ms=BOUND_MS))


@_query
def q10_gap_lag(spark, folder):
    return gaps.in_time_order(gaps.gap_lag(derived.calls(spark, folder)).drop("gap_duration"))


@_query
def q10_gap_seconds(spark, folder):
    """The gap to the previous call in whole seconds, by start."""
    found = gaps.gap_lag(derived.calls(spark, folder)).select(
        "caller",
        F.col("prev_end_ts").alias("prev_end_timestamp"),
        F.col("start_ts").alias("next_start_timestamp"),
        F.col("gap_seconds").alias("time_gap_seconds"),
    )
    return gaps.in_time_order(conform(found, schemas.GAP_SECONDS), "next_start_timestamp", by_caller=False)


@_query
def q10_gap_sql(spark, folder):
    """The same question as SQL text over a registered view."""
    sql_text.offer_gaps(spark, derived.calls(spark, folder))
    return spark.sql(sql_text.CONSECUTIVE_GAP)


@_query
def q10_gap_running_max(spark, folder):
    return gaps.gap_running_max(derived.calls(spark, folder))


@_query
def q10_gap_events_adjacent(spark, folder):
    return gaps.gap_events_adjacent(derived.call_events(spark, folder))


@_query
def q10_gap_events_last_end(spark, folder):
    return gaps.gap_events_last_end(derived.call_events(spark, folder))


@_query
def q10_gap_pattern(spark, folder):
    return gaps.gap_pattern(derived.calls(spark, folder))


@_query
def q10_gap_within_day(spark, folder):
    """Gaps to the latest end so far, none longer than a day."""
    return gaps.gap_running_max(derived.calls(spark, folder), ttl_ms=86_400_000)


@_query
def gap_clamped(spark, folder):
    return gaps.gap_clamped(derived.calls(spark, folder))


@_query
def span_to_events_calls(spark, folder):
    return derived.call_events(spark, folder)


@_query
def span_to_events_towers(spark, folder):
    return derived.tower_events(spark, folder)


@_query
def rebuild_calls(spark, folder):
    return sessions.rebuild_spans(derived.call_events(spark, folder), ["unique_id"])


@_query
def rebuild_towers(spark, folder):
    return sessions.rebuild_spans(derived.tower_events(spark, folder), ["unique_id", "tower"])


@_query
def pair_calls(spark, folder):
    return sessions.pair_calls(derived.call_events(spark, folder))


@_query
def pair_towers(spark, folder):
    return sessions.pair_towers(derived.tower_events(spark, folder))


@_query
def reconcile_lag_vs_runmax(spark, folder):
    calls = derived.calls(spark, folder)
    by_lag = gaps.gap_lag(calls).select(
        "caller", F.col("prev_end_ts").alias("prev_end"), F.col("start_ts").alias("next_start"), "gap_ms"
    )
    return compare.reconcile(by_lag, gaps.gap_running_max(calls))


@_query
def refresh_calls(spark, folder):
    """Calls written as CSV files and loaded into a table."""
    csv = new_folder(spark, "csv")
    signals.write_signal(derived.calls(spark, folder), csv)
    return tables.refresh_table(to_zone_free(signals.read_calls(spark, csv)), new_folder(spark, "table"))


def _stored(spark, rows: DataFrame, schema, **options) -> str:
    """A folder with ``rows`` as CSV files, columns in the order of the signal."""
    csv = new_folder(spark, "csv")
    signals.write_signal(rows.select(*schema.names), csv, **options)
    return csv


@_query
def csv_towers(spark, folder):
    """Tower spans written as CSV files and read back."""
    return to_zone_free(signals.read_towers(spark, _stored(spark, derived.towers(spark, folder), schemas.TOWERS)))


@_query
def csv_call_events(spark, folder):
    """Call events written as CSV files, among lines that cannot be read, and read back."""
    rows = derived.call_events(spark, folder)
    broken = rows.select(*[F.lit("?").alias(c) if c in ("unique_id", "ts") else F.col(c).cast("string").alias(c) for c in schemas.CALL_EVENTS.names])
    csv = _stored(spark, rows, schemas.CALL_EVENTS)
    signals.write_signal(broken, csv, mode="append")
    return to_zone_free(signals.read_call_events(spark, csv))


@_query
def csv_tower_events(spark, folder):
    """Tower events written as CSV files with a header line and read back."""
    csv = _stored(spark, derived.tower_events(spark, folder), schemas.TOWER_EVENTS, header=True)
    return to_zone_free(signals.read_tower_events(spark, csv, header=True))


@_query
def q10_gap_duration(spark, folder):
    """The gap as an interval, told in milliseconds."""
    found = gaps.gap_lag(derived.calls(spark, folder))
    start = F.to_timestamp(F.lit("1970-01-01 00:00:00"))
    return found.select("caller", "unique_id", F.unix_millis(start + F.col("gap_duration")).alias("duration_ms"))


# --- streams ------------------------------------------------------------------------


def _spread_ms(spark, folder) -> int:
    """The longest time that any call id fills, from the first to the last of its times.

    A replayed stream is out of order by no more than that, and neither the ends of a call and
    its towers nor the events of one key lie further apart.
    """
    times = [
        rows.select("unique_id", F.explode(F.array("start_ts", "end_ts")).alias("ts"))
        for rows in (derived.calls(spark, folder), derived.towers(spark, folder))
    ]
    ids = times[0].unionByName(times[1]).groupBy("unique_id").agg((millis(F.max("ts")) - millis(F.min("ts"))).alias("ms"))
    return (ids.agg(F.max("ms")).first()[0] or 0) + 1


def _delay(spread_ms: int) -> str:
    return f"{spread_ms} milliseconds"


def _feed(rows: DataFrame, order: list[str], **options) -> Feed:
    return stage_feed(rows, order, slices=SLICES, **options)


def _calls_feed(spark, folder, **options) -> DataFrame:
    return _feed(derived.calls(spark, folder), gaps.BY_START, **options).read(spark)


def _towers_feed(spark, folder, **options) -> DataFrame:
    return _feed(derived.towers(spark, folder), ["start_ts", "row_id"], **options).read(spark)


def _call_events_feed(spark, folder, **options) -> DataFrame:
    return _feed(derived.call_events(spark, folder), gaps.BY_EVENT, **options).read(spark)


def _tower_events_feed(spark, folder, **options) -> DataFrame:
    return _feed(derived.tower_events(spark, folder), gaps.BY_EVENT, **options).read(spark)


@_query
def stream_q2_bounded(spark, folder):
    pairs = overlap.bounded_overlap(
        _calls_feed(spark, folder),
        _towers_feed(spark, folder),
        bound_ms=BOUND_MS,
        connected_only=True,
        delay=_delay(_spread_ms(spark, folder)),
    )
    return run_to_table(_tower_only(pairs), allow_late=False)


@_query
def stream_q2_tolerant(spark, folder):
    """The tolerant overlap, with a bound wider than any call so that state can be dropped."""
    spread = _spread_ms(spark, folder)
    pairs = overlap.bounded_overlap(
        _calls_feed(spark, folder),
        _towers_feed(spark, folder),
        bound_ms=spread,
        tolerance_ms=TOLERANCE_MS,
        delay=_delay(spread),
    )
    return _by_call_id(run_to_table(pairs, allow_late=False))


@_query
def stream_q2_sessions(spark, folder):
    """Calls and towers paired on the stream, then joined; the table has one call per id."""
    spread = _spread_ms(spark, folder)
    pairs = streams.overlap_of_sessions(
        _call_events_feed(spark, folder),
        _tower_events_feed(spark, folder),
        bound_ms=BOUND_MS,
        delay=_delay(spread),
        max_open_ms=spread,
        one_call_per_id=True,
    )
    return run_to_table(_session_names(pairs), allow_late=False)


@_query
def stream_match_calls(spark, folder):
    spread = _spread_ms(spark, folder)
    return run_to_table(streams.match_calls(_call_events_feed(spark, folder), delay=_delay(spread), max_open_ms=spread), allow_late=False)


@_query
def stream_q2_sessions_carried(spark, folder):
    """Both event streams paired batch by batch, then one join over the stored spans."""
    calls = carried.run_carried(_call_events_feed(spark, folder), carried.pair_step(from_end=sessions.CALL_FIELDS))
    towers = carried.run_carried(_tower_events_feed(spark, folder), carried.pair_step(from_start=sessions.TOWER_FIELDS))
    return _session_names(overlap.bounded_overlap(calls, towers, bound_ms=BOUND_MS))


@_query
def stream_q2_minmax(spark, folder):
    spread = _spread_ms(spark, folder)
    pairs = streams.overlap_of_rebuilt(
        _call_events_feed(spark, folder, close_after_ms=5 * spread),
        _tower_events_feed(spark, folder, close_after_ms=5 * spread),
        delay=_delay(spread),
        max_span=_delay(spread),
        bound_ms=spread,
        tolerance_ms=TOLERANCE_MS,
    )
    return _by_call_id(run_to_table(pairs, allow_late=False))


@_query
def stream_q2_minmax_updates(spark, folder):
    """As above without any time limit: partial spans per batch, combined when read."""
    calls = carried.rebuild_partials(_call_events_feed(spark, folder), ["unique_id"])
    towers = carried.rebuild_partials(_tower_events_feed(spark, folder), ["unique_id", "tower"])
    return _by_call_id(overlap.partial_overlap(calls, towers, tolerance_ms=TOLERANCE_MS, policy=None))


def _gaps_of_calls(spark, folder, **options) -> DataFrame:
    # The feed is ordered by start, and so is its event time.
    feed = _calls_feed(spark, folder)
    found = streams.gaps_from_calls(feed, delay=FEED_DELAY, event_time="start_ts", **options)
    return run_to_table(found, allow_late=False)


@_query
def stream_q10_running_max(spark, folder):
    return _gaps_of_calls(spark, folder)


@_query
def stream_q10_lag(spark, folder):
    return _gaps_of_calls(spark, folder, latest=True)


@_query
def stream_q10_within_day(spark, folder):
    return _gaps_of_calls(spark, folder, ttl_ms=86_400_000)


@_query
def stream_q10_last_end(spark, folder):
    feed = _call_events_feed(spark, folder)
    return run_to_table(streams.gaps_from_events(feed, delay=FEED_DELAY), allow_late=False)


@_query
def stream_q10_running_max_carried(spark, folder):
    return carried.run_carried(_calls_feed(spark, folder), carried.running_max_step())


@_query
def stream_q10_lag_carried(spark, folder):
    return carried.run_carried(_calls_feed(spark, folder), carried.lag_step())


@_query
def stream_q10_last_end_carried(spark, folder):
    return carried.run_carried(_call_events_feed(spark, folder), carried.last_end_step())


@_query
def stream_q10_events_adjacent(spark, folder):
    return carried.run_carried(_call_events_feed(spark, folder), carried.adjacent_step())


@_query
def stream_q10_pattern(spark, folder):
    return carried.run_carried(_calls_feed(spark, folder), carried.pattern_step())


@_query
def stream_pair_calls(spark, folder):
    feed = _call_events_feed(spark, folder)
    return run_to_table(streams.pair_calls(feed, delay=FEED_DELAY), allow_late=False)


@_query
def stream_pair_towers(spark, folder):
    feed = _tower_events_feed(spark, folder)
    return run_to_table(streams.pair_towers(feed, delay=FEED_DELAY), allow_late=False)


@_query
def stream_pair_calls_carried(spark, folder):
    return carried.run_carried(_call_events_feed(spark, folder), carried.pair_step(from_end=sessions.CALL_FIELDS))


@_query
def stream_pair_towers_carried(spark, folder):
    return carried.run_carried(_tower_events_feed(spark, folder), carried.pair_step(from_start=sessions.TOWER_FIELDS))


@_query
def stream_csv_roundtrip(spark, folder):
    feed = _feed(derived.calls(spark, folder), gaps.BY_START, csv=True)
    return run_to_table(feed.read_csv(spark, schemas.CALLS, computed_times=True))


@_query
def stream_metrics(spark, folder):
    """Totals of the per-batch metrics of the bounded overlap: rows in, rows out, late rows."""
    pairs = overlap.bounded_overlap(
        _calls_feed(spark, folder),
        _towers_feed(spark, folder),
        bound_ms=BOUND_MS,
        connected_only=True,
        delay=_delay(_spread_ms(spark, folder)),
    )
    with BatchMetrics(spark) as metrics:
        query = start_query(pairs, "noop", checkpoint=new_folder(spark, "checkpoint"), name="bounded_overlap")
        finish(query)
        metrics.wait_for_end(query)
        return metrics.totals_df()


@_query
def stream_q2_tolerant_unbounded(spark, folder):
    """The tolerant overlap without any time bound: stored spans, read by time cell."""
    pairs = overlap_unbounded(_calls_feed(spark, folder), _towers_feed(spark, folder), tolerance_ms=TOLERANCE_MS)
    return _by_call_id(pairs)


@_query
def stream_q2_tolerant_by_start(spark, folder):
    """The tolerant overlap with watermarks on the starts, another delay for each side."""
    pairs = overlap.overlap_by_start(
        _calls_feed(spark, folder),
        _towers_feed(spark, folder),
        longest_ms=_spread_ms(spark, folder),
        tolerance_ms=TOLERANCE_MS,
        call_delay=FEED_DELAY,
        tower_delay="3 seconds",
    )
    return _by_call_id(run_to_table(pairs, allow_late=False))


@_query
def stream_rebuild_calls_updated(spark, folder):
    """First and last event per call in update mode, put into a keyed table by every batch."""
    return carried.rebuild_updating(_call_events_feed(spark, folder), ["unique_id"], folder=new_folder(spark, "updated"))


@_query
def stream_q2_minmax_upserted(spark, folder):
    """The overlap of two tables that update-mode streams keep corrected."""
    calls = carried.rebuild_updating(_call_events_feed(spark, folder), ["unique_id"], folder=new_folder(spark, "updated"))
    towers = carried.rebuild_updating(_tower_events_feed(spark, folder), ["unique_id", "tower"], folder=new_folder(spark, "updated"))
    return _by_call_id(overlap.partial_overlap(calls, towers, tolerance_ms=TOLERANCE_MS, policy=None))


#: The order in which the eight stretches of time of ``stream_late_rows`` arrive.
LATE_ORDER = (0, 3, 1, 2, 6, 4, 5, 7)


@_query
def stream_late_rows(spark, folder):
    """Calls that arrive out of order: those that came too late, and how many the stream counted.

    The time from the first to the last start is cut into eight stretches of equal length, which
    arrive in ``LATE_ORDER``; the watermark lies one hour behind.
    """
    calls = derived.calls(spark, folder).select("unique_id", "start_ts", "caller")
    facts = calls.agg(F.min(millis("start_ts")).alias("low"), F.max(millis("start_ts")).alias("high")).first()
    low, width = facts["low"] or 0, (facts["high"] or 0) - (facts["low"] or 0) + 1
    stretch = F.expr(f"(8 * (unix_millis(timestamp(start_ts)) - {low}L)) div {width}L")
    arrival = F.element_at(F.array(*[F.lit(LATE_ORDER.index(n)) for n in range(8)]), (stretch + 1).cast("int"))
    feed = stage_slices(calls, arrival, 8)
    taken = streams.admitted(feed.read(spark), key=["unique_id"], event_time="start_ts", delay="1 hour")
    with BatchMetrics(spark, keep=0) as metrics:
        path, checkpoint = new_folder(spark, "admitted"), new_folder(spark, "checkpoint")
        query = start_query(taken, "parquet", path=path, checkpoint=checkpoint)
        finish(query)
        metrics.wait_for_end(query)
    late = streams.late_table(calls, spark.read.schema(taken.schema).parquet(path), ["unique_id"])
    return late.withColumn("n_dropped", F.lit(metrics.late_rows(query)).cast("long"))


@_query
def stream_q10_running_max_restarted(spark, folder):
    """Gaps of a stream that ends, and goes on from its checkpoint once the table has grown."""
    calls = derived.calls(spark, folder)
    facts = calls.agg(F.min("start_ts").alias("low"), F.max("start_ts").alias("high")).first()
    half = F.lit(facts["low"] + (facts["high"] - facts["low"]) / 2 if facts["low"] else None).cast("timestamp_ntz")
    early = F.coalesce(F.col("start_ts") < half, F.lit(True))
    feed = _feed(calls.where(early), gaps.BY_START)
    table, checkpoint = new_folder(spark, "restarted"), new_folder(spark, "checkpoint")

    def run():
        out = streams.gaps_from_calls(feed.read(spark), delay=FEED_DELAY, event_time="start_ts")
        finish(start_query(out, "parquet", path=table, checkpoint=checkpoint))
        return out.schema

    run()
    feed = extend_feed(feed, _feed(calls.where(~early), gaps.BY_START))
    schema = run()
    return to_zone_free(spark.read.schema(schema).parquet(table))


@_query
def stream_gap_totals(spark, folder):
    """How many gaps each caller has and how long they are together, sorted within a stream in complete mode."""
    run = new_folder(spark, "carried")
    found = carried.run_carried(_calls_feed(spark, folder), carried.running_max_step(), folder=run)
    totals = carried.totals_per_key(f"{run}/result/*", found.schema, "caller", "gap_ms", folder=new_folder(spark, "totals"))
    return totals.select("caller", F.col("n").alias("n_gaps"), F.col("total").alias("total_gap_ms"))


@_query
def stream_run_time(spark, folder):
    """Whether a run of the bounded overlap has told its time in milliseconds, and its rows."""
    feed = _calls_feed(spark, folder)
    with BatchMetrics(spark) as metrics:
        query = start_query(feed.where(is_connected()), "noop", checkpoint=new_folder(spark, "checkpoint"), name="connected")
        run_ms = finish(query)
        metrics.wait_for_end(query)
        totals = metrics.totals_df()
    batches_ms = metrics.metrics_df().agg(F.sum("latency_ms")).first()[0] or 0
    timed = F.lit(run_ms > 0 and batches_ms > 0)
    return totals.select("query", "input_rows", timed.alias("timed"))
