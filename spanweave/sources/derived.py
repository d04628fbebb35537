"""Call and tower spans derived from an ``events`` table.

The table has ``event_id, ts, user_id, event_type, value, props``. Everything here is a
projection or an ``explode`` over a fixed array, so it runs inside the scan stage and only
the columns a query needs are read. Integer arithmetic keeps the values exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.times import shift
from spanweave.operators.sessions import span_to_events
from spanweave.schemas import EVENTS

_MAX_VISITS = 4


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")


def calls_from_events(events: DataFrame) -> DataFrame:
    """One call per event. ``error`` and ``signup`` events become calls of length zero."""
    kind = F.col("event_type")
    length = F.when(kind.isin("error", "signup"), F.lit(0)).otherwise(F.round(F.col("value") * 60000))
    return (
        events.withColumn("start_ts", F.date_trunc("MILLISECOND", "ts").cast("timestamp_ntz"))
        .withColumn("dur", length.cast("long"))
        .select(
            F.col("event_id").alias("unique_id"),
            "start_ts",
            shift("start_ts", F.col("dur")).alias("end_ts"),
            F.col("user_id").cast("string").alias("caller"),
            ((F.col("user_id") * 7919 + F.col("event_id")) % 1000).cast("string").alias("callee"),
            F.when(kind == "error", "failed").when(kind == "signup", "busy").otherwise("connected").alias("disposition"),
            (100000000 + F.col("event_id") % 10000000).alias("imei"),
            F.col("event_id").alias("row_id"),
            "dur",
        )
    )


def towers_from_calls(calls: DataFrame) -> DataFrame:
    """One to four consecutive tower visits per call, shifted so that some overhang it."""
    key, k, n, dur = F.col("unique_id"), F.col("k"), F.col("n"), F.col("dur")
    overhang = F.when(k == n - 1, (key * 37) % 2000).otherwise(0)
    return (
        calls.select(
            "unique_id",
            "start_ts",
            "dur",
            ((key * 7919) % 9001 - 4500).alias("off"),
            F.when(dur == 0, F.lit(1)).otherwise(1 + key % _MAX_VISITS).alias("n"),
        )
        .withColumn("k", F.explode(F.array(*(F.lit(i) for i in range(_MAX_VISITS)))))
        .where(k < n)
        .select(
            "unique_id",
            F.concat(F.lit("T"), (1 + (key + k % 3) % 10).cast("string")).alias("tower"),
            shift("start_ts", F.expr("off + (dur * k) div n")).alias("start_ts"),
            shift("start_ts", F.expr("off + (dur * (k + 1)) div n") + overhang).alias("end_ts"),
            (key * _MAX_VISITS + k).alias("row_id"),
        )
    )


def calls(spark: SparkSession, folder: str) -> DataFrame:
    return calls_from_events(read_events(spark, folder)).drop("dur")


def towers(spark: SparkSession, folder: str) -> DataFrame:
    return towers_from_calls(calls_from_events(read_events(spark, folder)))


def call_events(spark: SparkSession, folder: str) -> DataFrame:
    return span_to_events(calls(spark, folder))


def tower_events(spark: SparkSession, folder: str) -> DataFrame:
    return span_to_events(towers(spark, folder))
