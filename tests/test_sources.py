from __future__ import annotations

import datetime as dt

import pytest

from spanweave import schemas
from spanweave.operators import gaps
from spanweave.operators.compare import reconcile
from spanweave.plans import sql_text
from spanweave.schemas import conform, to_zone_free
from spanweave.sources import derived, signals, tables
from tests.conftest import DATA, calls_df, towers_df

GOOD = "{0},2024-01-01 00:00:0{0}.500,2024-01-01 00:00:09.001,99,98,connected,5,{0}\n"


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


@pytest.mark.parametrize("computed", [False, True])
def test_bad_rows_are_dropped(spark, tmp_path, computed):
    path = write(
        tmp_path / "in",
        "a.csv",
        "unique_id,start_ts,end_ts,caller,callee,disposition,imei,row_id\n"
        + GOOD.format(1)
        + "x,2024-01-01 00:00:02.500,2024-01-01 00:00:09.001,99,98,connected,5,2\n"
        + "3,yesterday,2024-01-01 00:00:09.001,99,98,connected,5,3\n"
        + "4,2024-01-01 00:00:02.500\n"
        + "\n"
        + GOOD.format(5),
    )
    write(tmp_path / "in", "b.csv", GOOD.format(6))
    write(tmp_path / "in", "notes.txt", GOOD.format(7))
    calls = signals.read_calls(spark, path, computed_times=computed)
    assert sorted(r.unique_id for r in calls.collect()) == [1, 5, 6]
    assert calls.count() == 3
    assert calls.schema == schemas.CALLS
    first = to_zone_free(calls).orderBy("unique_id").first()
    assert first.start_ts == dt.datetime(2024, 1, 1, 0, 0, 1, 500_000)
    assert (first.caller, first.imei) == ("99", 5)


def test_header_option_takes_the_first_line_of_each_file(spark, tmp_path):
    for n in (1, 2):
        path = write(tmp_path / "in", f"{n}.csv", GOOD.format(n) + GOOD.format(n + 3))
    assert signals.read_calls(spark, path).count() == 4
    assert signals.read_calls(spark, path, header=True).count() == 2


def test_other_signals(spark, tmp_path):
    towers = write(tmp_path / "t", "t.csv", "1,T4,2024-01-01 00:00:00.000,2024-01-01 00:00:01.000,0\n")
    assert signals.read_towers(spark, towers).first().tower == "T4"
    events = write(tmp_path / "e", "e.csv", "1,0,99,98,2024-01-01 00:00:00.000,busy,7,0\n")
    assert signals.read_call_events(spark, events).first().event_type == 0
    visits = write(
        tmp_path / "v",
        "v.csv",
        "unique_id,tower,event_type,timestamp,row_id\n1,T4,1,2024-01-01 00:00:00.000,0\n",
    )
    assert signals.read_tower_events(spark, visits).first().event_type == 1
    assert signals.read_tower_events(spark, visits, header=True).count() == 1


def test_write_and_read_back(spark, tmp_path):
    calls = derived.calls(spark, DATA)
    signals.write_signal(calls, str(tmp_path / "out"))
    back = to_zone_free(signals.read_calls(spark, str(tmp_path / "out")))
    assert reconcile(calls, back).count() == 0


def test_refresh_replaces_everything(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.refresh_table(calls_df(spark, [(1, 0, 1), (2, 0, 1)]), path)
    assert [r.unique_id for r in tables.refresh_table(calls_df(spark, [(3, 0, 1)]), path).collect()] == [3]


def test_views_and_sql(spark):
    calls = calls_df(spark, [(1, 0, 10), (2, 12, 20)])
    towers = towers_df(spark, [(1, "T1", 5, 11), (2, "T2", 13, 14)])
    sql_text.offer_spans(spark, calls, towers)
    sql_text.offer_overlaps(spark, calls, towers)
    sql_text.offer_gaps(spark, calls)
    tables.register_views(spark, calls, towers)
    assert [r.tower for r in spark.sql(sql_text.PARTIAL_OVERLAP).collect()] == ["T1"]
    assert spark.sql(sql_text.CONSECUTIVE_GAP).first().gap_ms == 2000
    assert spark.sql("SELECT start_ts - end_ts AS d FROM mono_signal WHERE unique_id = 1").first().d == -dt.timedelta(seconds=10)


def test_conform(spark):
    found = conform(gaps.gap_pattern(calls_df(spark, [(1, 0, 1), (2, 2, 3)])), schemas.GAP_SECONDS)
    assert found.schema == schemas.GAP_SECONDS
    assert found.first().time_gap_seconds == 1
