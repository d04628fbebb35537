"""The two batch questions in SQL, for sessions that work in SQL.

The results of the operators are offered as views, so SQL gets the same predicates and the same
treatment of hot ids and callers; calls and towers can be offered beside them for queries of one's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.operators.gaps import gap_lag
from spanweave.operators.overlap import partial_overlap

PARTIAL_OVERLAP = """
SELECT unique_id, caller, tower, call_start, call_end, tower_start, tower_end FROM spanweave_overlaps
"""

CONSECUTIVE_GAP = """
SELECT caller, unique_id, start_ts, end_ts, prev_end_ts, gap_ms, gap_seconds
FROM spanweave_gaps ORDER BY caller, start_ts
"""


def offer_spans(spark: SparkSession, calls: DataFrame, towers: DataFrame) -> None:
    """Make the views ``spanweave_calls`` and ``spanweave_towers`` known."""
    calls.createOrReplaceTempView("spanweave_calls")
    towers.createOrReplaceTempView("spanweave_towers")


def offer_overlaps(spark: SparkSession, calls: DataFrame, towers: DataFrame, **options) -> None:
    """Make the view ``spanweave_overlaps`` known, with the options of ``partial_overlap``."""
    partial_overlap(calls, towers, **options).createOrReplaceTempView("spanweave_overlaps")


def offer_gaps(spark: SparkSession, calls: DataFrame, **options) -> None:
    """Make the view ``spanweave_gaps`` known, with the options of ``gap_lag``."""
    gap_lag(calls, **options).createOrReplaceTempView("spanweave_gaps")
