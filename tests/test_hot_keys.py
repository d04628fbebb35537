"""The search for hot keys: exact, without a row per key in any shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanweave.operators import keyed
from spanweave.operators.keyed import HotKeyPolicy, find_hot_keys
from tests.test_plans import plan


def _rows(spark, unique, hot):
    """``unique`` keys of one row each and the given keys with as many rows as said."""
    rows = spark.range(unique).select(F.col("id").alias("k"))
    for key, n in hot.items():
        rows = rows.unionByName(spark.range(n).select(F.lit(key).cast("long").alias("k")))
    return rows


def _listed(hot):
    return {r.k: r._rows for r in hot.listed.collect()} if hot else {}


@pytest.mark.parametrize("cells", [1, 8, 4096])
def test_exactly_the_keys_over_the_limit_are_found(spark, monkeypatch, cells):
    monkeypatch.setattr(keyed, "_CELLS", cells)
    hot = {-1: 120, -2: 101, -3: 100, None: 500}
    found = find_hot_keys(_rows(spark, 20_000, hot), "k", HotKeyPolicy(rows_per_task=100))
    assert _listed(found) == {-1: 120, -2: 101, None: 500}
    assert (found.keys, found.rows) == (3, 721)


def test_a_hot_key_below_a_hundredth_of_a_percent_is_found(spark):
    found = find_hot_keys(_rows(spark, 500_000, {-7: 40}), "k", HotKeyPolicy(rows_per_task=30))
    assert _listed(found) == {-7: 40}


def test_rare_keys_are_never_grouped(spark, monkeypatch):
    """Without a heavy cell nothing is grouped by the key, with one only the keys of that cell."""
    grouped = []
    plain = keyed._heavy_cells
    monkeypatch.setattr(keyed, "_heavy_cells", lambda df, key, limit, cells: grouped.append(cells) or plain(df, key, limit, cells))
    assert not find_hot_keys(_rows(spark, 100_000, {}), "k", HotKeyPolicy(rows_per_task=200))
    assert grouped == [4096]
    cells = keyed._heavy_cells(_rows(spark, 100_000, {-1: 300}), "k", 200, 4096)
    assert cells[1] == 100_300 and len(cells[2]) == 1


def test_no_rows(spark):
    assert not find_hot_keys(_rows(spark, 0, {}), "k", HotKeyPolicy(rows_per_task=1))


def test_split_keeps_every_row(spark):
    rows = _rows(spark, 500, {-1: 50, None: 60})
    cold, hot = find_hot_keys(rows, "k", HotKeyPolicy(rows_per_task=20)).split(rows)
    assert (cold.count(), hot.count()) == (500, 110)
    assert "Exchange hashpartitioning" not in plan(cold)
