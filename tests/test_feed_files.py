"""Feeds and partial results of large tables: as many tasks as their rows ask for, nothing kept in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.sources import derived
from spanweave.operators import gaps
from spanweave.operators.compare import reconcile
from spanweave.operators.sessions import rebuild_spans
from spanweave.streaming import carried
from spanweave.streaming.feeds import stage_feed
from tests.conftest import DATA


def test_a_slice_of_many_rows_is_read_by_several_tasks(spark):
    rows = spark.range(1_200_000).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("at"))
    feed = stage_feed(rows, ["at"], slices=2)
    # One file of 600,000 rows per slice was sorted, written and read by one task.
    assert (feed.files_per_slice, feed.files) == (3, 6)
    assert spark.read.parquet(feed.path).distinct().count() == 1_200_000


def test_partial_spans_keep_no_batch(spark, monkeypatch):
    def kept(*_):
        raise AssertionError("a batch that is read once was kept")

    events = derived.call_events(spark, DATA)
    feed = stage_feed(events, gaps.BY_EVENT, slices=2)
    monkeypatch.setattr(DataFrame, "persist", kept)
    monkeypatch.setattr(type(events), "persist", kept)
    found = carried.rebuild_partials(feed.read(spark), ["unique_id"])
    assert reconcile(rebuild_spans(events, ["unique_id"]), found).count() == 0
