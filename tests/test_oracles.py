"""Each catalog query against its SQL on DuckDB, over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from spanweave.plans import catalog as module
from spanweave.plans.catalog import catalog
from spanweave.plans.oracles import oracles
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


@pytest.fixture(autouse=True)
def few_slices(monkeypatch):
    """Three micro-batches rather than eight, to save time."""
    monkeypatch.setattr(module, "SLICES", 3)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    for name in frame.columns:
        if frame[name].dtype.kind == "M":
            frame[name] = frame[name].astype("datetime64[us]")
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_sql(spark, duck, name):
    ours = catalog()[name](spark, DATA).toPandas()
    theirs = duck.sql(oracles()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs) > 0
    ours, theirs = _rows(ours), _rows(theirs)
    for column in ours.columns:
        assert (ours[column].values == theirs[column].values).all(), column


def test_every_query_has_sql():
    assert set(catalog()) == set(oracles())
    assert set(catalog()) <= set(driver.queries()) and set(oracles()) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() == 690


def test_metrics_query(spark):
    row = catalog()["stream_metrics"](spark, DATA).first()
    # 1,000 calls and 1,900 towers
    assert (row.query, row.input_rows, row.output_rows, row.late_rows) == ("bounded_overlap", 2900, 431, 0)
