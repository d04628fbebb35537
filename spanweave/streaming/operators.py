"""The streaming forms of the span operators: streaming DataFrame in and out.

Inputs have TIMESTAMP times. Watermark delays must cover how far rows can be out of order;
rows that come later are dropped, and counted in the metrics of the query.

``buckets`` is the number of groups into which keyed state is divided. A bucket is read and written as
a whole, so choose several times the number of state partitions, and so many that a bucket holds
thousands of keys rather than millions. Keep the number for as long as a checkpoint is used: it
does not follow the size of the cluster.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.predicates import is_connected, is_end, is_start, partly_overlaps
from spanweave.functions.times import millis
from spanweave.operators.overlap import bounded_overlap, end_cells
from spanweave.operators.sessions import CALL_FIELDS
from spanweave.streaming.processors import CLOSED_AFTER_MS, GapProcessor, NearProcessor, PairProcessor, SpanProcessor

BUCKETS = 64
# Joins hold both sides, so their buckets are smaller.
JOIN_BUCKETS = 128


def gaps_from_calls(
    calls: DataFrame,
    *,
    delay: str,
    latest: bool = False,
    ttl_ms: int | None = None,
    connected_only: bool = True,
    event_time: str = "end_ts",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Gaps to the latest end so far, or with ``latest`` to the end of the previous call.

    ``event_time`` carries the watermark: the end, or ``start_ts`` where calls arrive by start.
    """
    rows = calls.where(is_connected()) if connected_only else calls
    rows = rows.where(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
    rows = rows.withWatermark(event_time, delay).select(
        _bucket("caller", buckets),
        "caller",
        event_time,
        millis("start_ts").alias("at_ms"),
        F.col("unique_id").alias("tie"),
        millis("start_ts").alias("start_ms"),
        millis("end_ts").alias("end_ms"),
    )
    return _gaps(rows, GapProcessor(latest=latest, ttl_ms=ttl_ms))


def gaps_from_events(
    events: DataFrame,
    *,
    delay: str,
    ttl_ms: int | None = None,
    connected_only: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Gaps from the last END event to each START."""
    rows = events.where(is_connected()) if connected_only else events
    at = millis("ts")
    rows = rows.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        _bucket("caller", buckets),
        "caller",
        "ts",
        at.alias("at_ms"),
        F.col("row_id").alias("tie"),
        F.when(is_start(), at).alias("start_ms"),
        F.when(is_end(), at).alias("end_ms"),
    )
    return _gaps(rows, GapProcessor(latest=True, ttl_ms=ttl_ms))


def pair_calls(
    events: DataFrame, *, delay: str, max_open_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Call spans from call events, as soon as their END arrives."""
    carried = {"caller": "string", "callee": "string", "imei": "long"}
    return _pairs(events, delay, buckets, PairProcessor({}, carried, max_open_ms))


def pair_towers(
    events: DataFrame, *, delay: str, max_open_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Tower spans from tower events, one open visit per call."""
    return _pairs(events, delay, buckets, PairProcessor({"tower": "string"}, {}, max_open_ms))


def match_calls(
    events: DataFrame, *, delay: str, max_open_ms: int, fields: tuple[str, ...] = CALL_FIELDS, buckets: int = JOIN_BUCKETS
) -> DataFrame:
    """Call spans as an interval join of START and END events, for ids with one call each.

    An END waits for its START and the other way round, and either is dropped
    once the watermark has passed the time in which its partner could come. Equal to
    ``pair_calls`` where an id has one START and one END; an id with several gets every END paired
    with every START up to ``max_open_ms`` before it. ``fields`` are taken from the END.
    """
    rows = events.withWatermark("ts", delay).where(F.col("unique_id").isNotNull() & F.col("ts").isNotNull() & (is_start() | is_end()))
    carried = {n: "string" for n in ("row_id", *fields)}
    rows = rows.select(
        _bucket("unique_id", buckets),
        "unique_id",
        is_end().alias("is_right"),
        "ts",
        millis("ts").alias("at_ms"),
        F.col("row_id").cast("string").alias("row_id"),
        *(F.when(is_end(), F.col(n).cast("string")).alias(n) for n in fields),
    )
    wanted = ["left_row_id", "right_row_id", *(f"right_{n}" for n in fields)]
    pairs = _near(rows, NearProcessor(["unique_id"], carried, wanted, 0, int(max_open_ms), "end_ts"))
    after = (F.col("right_ms") > F.col("left_ms")) | (F.col("right_row_id").cast("long") > F.col("left_row_id").cast("long"))
    return pairs.where(after).select(
        "unique_id",
        *(F.col(f"right_{n}").cast(events.schema[n].dataType).alias(n) for n in fields),
        _instant("left_ms").alias("start_ts"),
        "end_ts",
    )


def join_near(left: DataFrame, right: DataFrame, keys: list[str], *, bound_ms: int, wanted: list[str], buckets: int = JOIN_BUCKETS) -> DataFrame:
    """Pairs of equal keys whose times ``at`` lie at most ``bound_ms`` apart.

    Both sides have the ``keys`` (whole numbers), ``at`` with a watermark, ``name`` (string or null) and
    ``start_ms``. The rows of a bucket are joined as whole columns, so a row costs a few
    microseconds; a native stream-stream join reads and writes its state row by row. Rows are kept until the
    watermark has passed ``at`` by the bound. The result has ``left_ms``, ``right_ms`` (the times) and the ``wanted``
    among ``left_name, left_start_ms, right_name, right_start_ms``.
    """
    sides = [
        side.where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, "at")])).select(
            F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"),
            *keys,
            F.lit(is_right).alias("is_right"),
            "at",
            millis("at").alias("at_ms"),
            F.col("name").cast("string").alias("name"),
            "start_ms",
        )
        for side, is_right in ((left, False), (right, True))
    ]
    return _near(sides[0].unionByName(sides[1]), NearProcessor(keys, {"name": "string", "start_ms": "long"}, wanted, -int(bound_ms), int(bound_ms)))


def _near(rows: DataFrame, processor: NearProcessor) -> DataFrame:
    named = {"eventTimeColumnName": processor.event_time} if processor.event_time else {}
    return rows.groupBy("bucket").transformWithStateInPandas(
        processor, processor.output_schema, outputMode="append", timeMode="eventTime", **named
    )


def overlap_of_sessions(
    call_events: DataFrame,
    tower_events: DataFrame,
    *,
    bound_ms: int,
    delay: str,
    max_open_ms: int | None = None,
    one_call_per_id: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Pair both event streams into spans, then join the spans on their ends.

    The paired ``end_ts`` carries the watermark on, so the join can drop old rows. With
    ``one_call_per_id`` (needs ``max_open_ms``) calls are paired by ``match_calls`` and both
    sides joined by ``join_near``, on the id and cell of end time as in ``bounded_overlap``.
    """
    towers = pair_towers(tower_events, delay=delay, max_open_ms=max_open_ms, buckets=buckets)
    if not one_call_per_id:
        calls = pair_calls(call_events, delay=delay, max_open_ms=max_open_ms, buckets=buckets)
        return bounded_overlap(calls, towers, bound_ms=bound_ms)
    calls = match_calls(call_events, delay=delay, max_open_ms=max_open_ms, fields=("caller",))
    c, t = end_cells(calls, towers, "end_ts", bound_ms)
    c = c.select("unique_id", F.col("_cell").alias("cell"), F.col("end_ts").alias("at"), F.col("caller").alias("name"), millis("start_ts").alias("start_ms"))
    t = t.select("unique_id", F.col("_cell").alias("cell"), F.col("end_ts").alias("at"), F.col("tower").alias("name"), millis("start_ts").alias("start_ms"))
    wanted = ["left_name", "left_start_ms", "right_name", "right_start_ms"]
    pairs = join_near(c, t, ["unique_id", "cell"], bound_ms=bound_ms, wanted=wanted).select(
        "unique_id",
        F.col("left_name").alias("caller"),
        F.col("right_name").alias("tower"),
        _instant("left_start_ms").alias("call_start"),
        _instant("left_ms").alias("call_end"),
        _instant("right_start_ms").alias("tower_start"),
        _instant("right_ms").alias("tower_end"),
    )
    return pairs.where(partly_overlaps("tower_start", "tower_end", "call_start", "call_end"))


def overlap_of_rebuilt(
    call_events: DataFrame,
    tower_events: DataFrame,
    *,
    delay: str,
    max_span: str,
    bound_ms: int,
    tolerance_ms: int = 3000,
) -> DataFrame:
    """First and last event per call and per (call, tower) as spans, then their overlap.

    A span is complete once no event of its key can come within ``max_span`` any more, so the
    result equals the batch form if the events of a key lie closer together than that.
    ``bound_ms`` limits how far the last events of call and tower may lie apart.
    """
    c = _rebuilt(call_events, [], delay, max_span).withColumn("name", F.lit(None).cast("string"))
    t = _rebuilt(tower_events, ["tower"], delay, max_span).withColumnRenamed("tower", "name")
    wanted = ["left_start_ms", "right_name", "right_start_ms"]
    pairs = join_near(c, t, ["unique_id"], bound_ms=bound_ms, wanted=wanted).select(
        "unique_id",
        F.col("right_name").alias("tower"),
        _instant("left_start_ms").alias("call_start"),
        F.timestamp_millis(F.col("left_ms") - CLOSED_AFTER_MS).alias("call_end"),
        _instant("right_start_ms").alias("tower_start"),
        F.timestamp_millis(F.col("right_ms") - CLOSED_AFTER_MS).alias("tower_end"),
    )
    return pairs.where(partly_overlaps("tower_start", "tower_end", "call_start", "call_end", tolerance_ms))


def _rebuilt(events: DataFrame, names: list[str], delay: str, max_span: str, buckets: int = JOIN_BUCKETS) -> DataFrame:
    """Sessions of an id (and ``names``): ``start_ms``, and ``at``, which is just behind the last event."""
    spark = events.sparkSession
    # As in a session window, an event is late once ``max_span`` after it lies before the watermark.
    delay_ms, span_ms = (_millis_of(spark, text) for text in (delay, max_span))
    rows = events.withWatermark("ts", f"{delay_ms + span_ms} milliseconds").where(F.col("unique_id").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select(_bucket("unique_id", buckets), "unique_id", *names, "ts", millis("ts").alias("at_ms"))
    processor = SpanProcessor(names, span_ms)
    spans = rows.groupBy("bucket").transformWithStateInPandas(
        processor, processor.output_schema, outputMode="append", timeMode="eventTime", eventTimeColumnName="closed"
    )
    return spans.select("unique_id", *names, F.col("first_ms").alias("start_ms"), F.col("closed").alias("at"))


def _millis_of(spark: SparkSession, length: str) -> int:
    """An interval such as ``2 days`` in milliseconds."""
    return spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + CAST('{length}' AS INTERVAL)) AS ms").first()["ms"]


def _gaps(rows: DataFrame, processor: GapProcessor) -> DataFrame:
    out = rows.groupBy("bucket").transformWithStateInPandas(
        processor, processor.output_schema, outputMode="append", timeMode="eventTime"
    )
    return out.select(
        "caller",
        _instant("prev_end_ms").alias("prev_end"),
        _instant("next_start_ms").alias("next_start"),
        "gap_ms",
    )


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _pairs(events: DataFrame, delay: str, buckets: int, processor: PairProcessor) -> DataFrame:
    carried = [*processor.start_fields, *processor.end_fields]
    rows = events.where(F.col("unique_id").isNotNull() & F.col("ts").isNotNull())
    rows = rows.withWatermark("ts", delay).select(
        _bucket("unique_id", buckets),
        "unique_id", "event_type", "ts", millis("ts").alias("ts_ms"), "row_id", *carried
    )
    out = rows.groupBy("bucket").transformWithStateInPandas(
        processor,
        processor.output_schema,
        outputMode="append",
        timeMode="eventTime",
        eventTimeColumnName="end_ts",
    )
    return out.select("unique_id", *carried, _instant("start_ms").alias("start_ts"), "end_ts")


def _instant(ms: str) -> Column:
    return F.timestamp_millis(F.col(ms))


def admitted(rows: DataFrame, *, key: list[str], event_time: str, delay: str) -> DataFrame:
    """The rows that a keyed operator with this watermark would admit, one per key.

    A row that is not among them came after the watermark; the rows that came late are the input
    without these, see ``late_table``.
    """
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([*key, event_time]).select(*key, event_time)


def late_table(arrived: DataFrame, taken: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a table that the stream over it did not take: a table of late rows, to be fed again."""
    return arrived.join(taken.select(*key), key, "left_anti")
