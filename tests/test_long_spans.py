"""Streams on tables whose spans last days: nothing may depend on how long a span is."""

from __future__ import annotations


import duckdb
import pytest
from pyspark.sql import functions as F

from spanweave.operators import overlap
from spanweave.operators.gaps import gap_lag
from spanweave.operators.sessions import pair_towers
from spanweave.plans import catalog as module
from spanweave.plans.catalog import catalog
from spanweave.plans.oracles import oracles
from tests.conftest import DATA, calls_df, seconds, tower_events_df, towers_df


@pytest.fixture(scope="module")
def long_table(spark, tmp_path_factory):
    """The events, every 20th call 83 hours or 14 days long."""
    folder = str(tmp_path_factory.mktemp("long"))
    minutes = F.when(F.col("event_id") % 40 == 0, 14 * 1440.0).otherwise(83 * 60.0)
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("value", F.when(F.col("event_id") % 20 == 0, minutes).otherwise(F.col("value")))
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["stream_q2_bounded", "stream_q2_tolerant", "stream_q2_sessions", "stream_q2_minmax", "stream_q10_running_max", "stream_pair_calls"])
def test_long_spans_lose_nothing(spark, long_table, name, monkeypatch):
    monkeypatch.setattr(module, "SLICES", 8)
    folder, con = long_table
    ours = catalog()[name](spark, folder).count()
    assert ours == con.sql(f"SELECT count(*) FROM ({oracles()[name]})").fetchall()[0][0] > 0


def test_a_bound_of_zero_and_missing_values(spark):
    calls = calls_df(spark, [(1, 0, 10), (2, 5, 8)])
    towers = towers_df(spark, [(1, "a", -1, 10), (1, "b", -1, 11)])
    assert [r.tower for r in overlap.bounded_overlap(calls, towers, bound_ms=0).collect()] == ["a"]
    gaps = gap_lag(calls_df(spark, [(1, 0, 1), (2, 2, None), (3, 5, 6)])).collect()
    assert [(seconds(r.prev_end_ts), seconds(r.start_ts)) for r in gaps] == [(1, 5)]
    events = tower_events_df(spark, [(None, "a", 0, 0), (None, "a", 1, 3)])
    assert pair_towers(events).count() == 0
