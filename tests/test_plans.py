"""What the plans look like: pushdown, pruning, shuffles, no Python."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from spanweave.operators import gaps, overlap
from spanweave.plans.catalog import catalog
from spanweave.sources import signals, tables
from tests.conftest import DATA


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def tree(df) -> str:
    return plan(df).split("\n\n\n")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Calls and towers as parquet tables, and no broadcast joins, as for large tables."""
    from spanweave.sources import derived

    folder = tmp_path_factory.mktemp("plans")
    calls = tables.refresh_table(derived.calls(spark, DATA), f"{folder}/calls")
    towers = tables.refresh_table(derived.towers(spark, DATA), f"{folder}/towers")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield calls, towers
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_gaps_need_one_shuffle_and_four_columns(stored):
    for op in (gaps.gap_lag, gaps.gap_running_max):
        text = plan(op(stored[0]))
        assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
        assert len(re.findall(r"^\(\d+\) Window", text, re.M)) == 1
        assert "EqualTo(disposition,connected)" in text
        columns = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
        assert sorted(c.split(":")[0] for c in columns.split(",")) == [
            "caller", "disposition", "end_ts", "start_ts", "unique_id",
        ]


def test_overlap_is_one_join_with_a_residual_condition(stored):
    text = plan(overlap.partial_overlap(*stored, connected_only=True))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 2
    assert len(re.findall(r"^\(\d+\) \w*Join", text, re.M)) == 1
    assert re.search(r"Join condition: .*tower_start", text)
    assert "EqualTo(disposition,connected)" in text
    assert "callee" not in text and "imei" not in text


def test_bounded_overlap_joins_on_id_and_cell(stored):
    text = plan(overlap.bounded_overlap(*stored, bound_ms=10_000))
    assert re.search(r"Left keys \[2\]: \[unique_id#\d+L, _cell#\d+L\]", text)
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 2


def test_filter_reaches_the_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    text = plan(gaps.gap_lag(signals.read_calls(spark, str(tmp_path))))
    assert "EqualTo(disposition,connected)" in text


@pytest.mark.parametrize("name", [n for n in catalog() if not n.startswith("stream_")])
def test_batch_queries_stay_in_the_jvm(spark, name):
    text = tree(catalog()[name](spark, DATA))
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|NestedLoop", text)
