from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import SparkSession

from spanweave import schemas
from spanweave.session import prepare_session

DATA = "/root/testdata/sf0.001"
EPOCH = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("spanweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spanweave-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield prepare_session(session)
    session.stop()


def at(seconds: float | None):
    """A time given in seconds after a fixed day."""
    return None if seconds is None else EPOCH + dt.timedelta(seconds=seconds)


def seconds(ts) -> float:
    return (ts - EPOCH).total_seconds()


def _frame(spark, rows, schema):
    return schemas.to_zone_free(spark.createDataFrame(rows, schema))


def calls_df(spark, rows):
    """Rows (id, start, end[, caller[, disposition]])."""
    full = []
    for n, (uid, start, end, *rest) in enumerate(rows):
        caller = rest[0] if rest else "a"
        disposition = rest[1] if len(rest) > 1 else "connected"
        full.append((uid, at(start), at(end), caller, "b", disposition, 1, n))
    return _frame(spark, full, schemas.CALLS)


def towers_df(spark, rows):
    """Rows (id, tower, start, end)."""
    return _frame(spark, [(i, t, at(s), at(e), n) for n, (i, t, s, e) in enumerate(rows)], schemas.TOWERS)


def tower_events_df(spark, rows):
    """Rows (id, tower, type, time), in order of arrival."""
    return _frame(spark, [(i, t, k, at(s), n) for n, (i, t, k, s) in enumerate(rows)], schemas.TOWER_EVENTS)


def call_events_df(spark, rows):
    """Rows (id, type, time[, caller[, disposition]]), in order of arrival."""
    full = []
    for n, (uid, kind, when, *rest) in enumerate(rows):
        caller = rest[0] if rest else "a"
        disposition = rest[1] if len(rest) > 1 else "connected"
        full.append((uid, kind, caller, "b", at(when), disposition, 1, n))
    return _frame(spark, full, schemas.CALL_EVENTS)
