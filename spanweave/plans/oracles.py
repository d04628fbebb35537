"""DuckDB SQL with the same results as the catalog, on the same input tables."""

from __future__ import annotations

_INPUT = """
WITH calls AS (
  SELECT event_id AS unique_id, s AS start_ts, s + to_milliseconds(dur) AS end_ts,
         CAST(user_id AS VARCHAR) AS caller,
         CAST((user_id * 7919 + event_id) % 1000 AS VARCHAR) AS callee,
         disposition, 100000000 + event_id % 10000000 AS imei, event_id AS row_id, dur
  FROM (SELECT *, date_trunc('milliseconds', ts) AS s,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'busy'
                    ELSE 'connected' END AS disposition,
               CASE WHEN event_type IN ('error', 'signup') THEN 0
                    ELSE CAST(round(value * 60000) AS BIGINT) END AS dur
        FROM events)),
towers AS (
  SELECT unique_id, 'T' || CAST(1 + (unique_id + k % 3) % 10 AS VARCHAR) AS tower,
         start_ts + to_milliseconds(off + (dur * k) // n) AS start_ts,
         start_ts + to_milliseconds(off + (dur * (k + 1)) // n
           + CASE WHEN k = n - 1 THEN (unique_id * 37) % 2000 ELSE 0 END) AS end_ts,
         unique_id * 4 + k AS row_id
  FROM (SELECT *, (unique_id * 7919) % 9001 - 4500 AS off,
               CASE WHEN dur = 0 THEN 1 ELSE 1 + unique_id % 4 END AS n FROM calls),
       (SELECT unnest(range(4)) AS k)
  WHERE k < n),
bi_calls AS (
  SELECT unique_id, caller, callee, disposition, imei, 0 AS event_type, start_ts AS ts, row_id * 2 AS row_id FROM calls
  UNION ALL
  SELECT unique_id, caller, callee, disposition, imei, 1, end_ts, row_id * 2 + 1 FROM calls),
bi_towers AS (
  SELECT unique_id, tower, 0 AS event_type, start_ts AS ts, row_id * 2 AS row_id FROM towers
  UNION ALL
  SELECT unique_id, tower, 1, end_ts, row_id * 2 + 1 FROM towers),
call_pairs AS (
  SELECT unique_id, caller, callee, imei, prev_ts AS start_ts, ts AS end_ts
  FROM (SELECT *, lag(ts) OVER w AS prev_ts, lag(event_type) OVER w AS prev_type
        FROM bi_calls WINDOW w AS (PARTITION BY unique_id ORDER BY ts, row_id))
  WHERE event_type = 1 AND prev_type = 0),
tower_pairs AS (
  SELECT unique_id, prev_tower AS tower, prev_ts AS start_ts, ts AS end_ts
  FROM (SELECT *, lag(ts) OVER w AS prev_ts, lag(event_type) OVER w AS prev_type, lag(tower) OVER w AS prev_tower
        FROM bi_towers WINDOW w AS (PARTITION BY unique_id ORDER BY ts, row_id))
  WHERE event_type = 1 AND prev_type = 0),
call_minmax AS (
  SELECT unique_id, min(ts) AS start_ts, max(ts) AS end_ts FROM bi_calls GROUP BY unique_id),
tower_minmax AS (
  SELECT unique_id, tower, min(ts) AS start_ts, max(ts) AS end_ts FROM bi_towers GROUP BY unique_id, tower),
lagged AS (
  SELECT *, lag(end_ts) OVER (PARTITION BY caller ORDER BY start_ts, unique_id) AS prev_end
  FROM calls WHERE disposition = 'connected'),
lag_gaps AS (SELECT * FROM lagged WHERE start_ts > prev_end),
running AS (
  SELECT *, max(end_ts) OVER (PARTITION BY caller ORDER BY start_ts, unique_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end
  FROM calls WHERE disposition = 'connected'),
max_gaps AS (
  SELECT caller, prev_end, start_ts AS next_start, epoch_ms(start_ts) - epoch_ms(prev_end) AS gap_ms
  FROM running WHERE start_ts > prev_end)
"""

_OUTSIDE = "NOT (t.start_ts >= c.start_ts AND t.end_ts <= c.end_ts)"
_STRICT = f"t.start_ts < c.end_ts AND t.end_ts > c.start_ts AND {_OUTSIDE}"
_TOLERANT = (
    "t.start_ts < c.end_ts + INTERVAL 3 SECOND AND t.end_ts > c.start_ts - INTERVAL 3 SECOND "
    f"AND {_OUTSIDE}"
)
_NEAR = "t.end_ts BETWEEN c.end_ts - INTERVAL 10 SECOND AND c.end_ts + INTERVAL 10 SECOND"
_BY_CALL_ID = (
    "SELECT c.unique_id AS call_id, t.tower, c.start_ts AS call_start, c.end_ts AS call_end, "
    "t.start_ts AS tower_start, t.end_ts AS tower_end"
)
_LAST = "epoch_ms(ts) - epoch_ms(prev_end) AS gap_ms"

_OVERLAP = f"""
SELECT c.unique_id, c.caller, t.tower, c.start_ts AS call_start, c.end_ts AS call_end,
       t.start_ts AS tower_start, t.end_ts AS tower_end
FROM calls c JOIN towers t ON c.unique_id = t.unique_id WHERE {_STRICT}"""
_OVERLAP_TOLERANT = f"{_BY_CALL_ID} FROM calls c JOIN towers t ON c.unique_id = t.unique_id WHERE {_TOLERANT}"
_OVERLAP_BOUNDED = f"""
SELECT c.unique_id, t.tower, t.start_ts AS tower_start_ts, t.end_ts AS tower_end_ts
FROM calls c JOIN towers t ON c.unique_id = t.unique_id
WHERE c.disposition = 'connected' AND {_NEAR} AND {_STRICT}"""
_OVERLAP_MINMAX = f"""
{_BY_CALL_ID} FROM call_minmax c JOIN tower_minmax t ON c.unique_id = t.unique_id WHERE {_TOLERANT}"""
_OVERLAP_SESSIONS = f"""
SELECT c.unique_id AS "CallID", t.tower AS "Tower", t.start_ts AS "TowerStart", t.end_ts AS "TowerEnd"
FROM call_pairs c JOIN tower_pairs t ON c.unique_id = t.unique_id WHERE {_NEAR} AND {_STRICT}"""
_GAP_LAG = """
SELECT caller, unique_id, start_ts, end_ts, prev_end AS prev_end_ts,
       epoch_ms(start_ts) - epoch_ms(prev_end) AS gap_ms,
       (epoch_ms(start_ts) - epoch_ms(prev_end)) // 1000 AS gap_seconds
FROM lag_gaps"""
_GAP_SECONDS = """
SELECT caller, prev_end AS prev_end_timestamp, start_ts AS next_start_timestamp,
       (epoch_ms(start_ts) - epoch_ms(prev_end)) // 1000 AS time_gap_seconds FROM lag_gaps"""
_GAP_LAG_SHORT = """
SELECT caller, prev_end, start_ts AS next_start, epoch_ms(start_ts) - epoch_ms(prev_end) AS gap_ms FROM lag_gaps"""
_GAP_MAX = "SELECT * FROM max_gaps"
_GAP_MAX_DAY = "SELECT * FROM max_gaps WHERE gap_ms <= 86400000"
_GAP_ADJACENT = """
SELECT caller, prev_ts AS prev_end_timestamp, ts AS next_start_timestamp,
       (epoch_ms(ts) - epoch_ms(prev_ts)) // 1000 AS time_gap_seconds
FROM (SELECT *, lag(ts) OVER w AS prev_ts, lag(event_type) OVER w AS prev_type
      FROM bi_calls WHERE disposition = 'connected' WINDOW w AS (PARTITION BY caller ORDER BY ts, row_id))
WHERE event_type = 0 AND prev_type = 1 AND ts > prev_ts"""
_GAP_LAST_END = f"""
SELECT caller, prev_end, ts AS next_start, {_LAST}
FROM (SELECT *, last_value(CASE WHEN event_type = 1 THEN ts END IGNORE NULLS)
               OVER (PARTITION BY caller ORDER BY ts, row_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM bi_calls)
WHERE event_type = 0 AND ts > prev_end"""
_GAP_PATTERN = """
SELECT caller, prev_end AS prev_end_timestamp, start_ts AS next_start_timestamp,
       (epoch_ms(start_ts) - epoch_ms(prev_end)) // 1000 AS time_gap_seconds
FROM (SELECT *, lag(end_ts) OVER w AS prev_end, lag(disposition) OVER w AS prev_disposition
      FROM calls WINDOW w AS (PARTITION BY caller ORDER BY start_ts, unique_id))
WHERE disposition = 'connected' AND prev_disposition = 'connected' AND start_ts > prev_end"""
_RECONCILE = """,
a AS (SELECT caller, prev_end, start_ts AS next_start,
             epoch_ms(start_ts) - epoch_ms(prev_end) AS gap_ms FROM lag_gaps)
SELECT side, caller, prev_end, next_start, gap_ms, count(*) AS copies
FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM max_gaps)
      UNION ALL
      SELECT 'right' AS side, * FROM (SELECT * FROM max_gaps EXCEPT ALL SELECT * FROM a))
GROUP BY ALL"""
_METRICS = f"""
SELECT 'bounded_overlap' AS query, (SELECT count(*) FROM calls) + (SELECT count(*) FROM towers) AS input_rows,
       (SELECT count(*) FROM ({_OVERLAP_BOUNDED})) AS output_rows, CAST(0 AS BIGINT) AS late_rows"""
_ARRIVAL = (0, 3, 1, 2, 6, 4, 5, 7)
# The watermark of a batch comes from the batches before the one before it.
_LATE = f"""
, placed AS (SELECT unique_id, start_ts, caller, list_position({list(_ARRIVAL)}, CAST((8 * (epoch_ms(start_ts) - low)) // (high - low + 1) AS INTEGER)) - 1 AS batch
  FROM calls, (SELECT min(epoch_ms(start_ts)) AS low, max(epoch_ms(start_ts)) AS high FROM calls)),
marks AS (SELECT b.batch, max(p.start_ts) - INTERVAL 1 HOUR AS mark FROM (SELECT unnest(range(8)) AS batch) b JOIN placed p ON p.batch < b.batch - 1 GROUP BY b.batch)
SELECT unique_id, start_ts, caller, count(*) OVER () AS n_dropped FROM placed JOIN marks USING (batch) WHERE start_ts <= mark"""
_TOTALS = "SELECT caller, count(*) AS n_gaps, CAST(sum(gap_ms) AS BIGINT) AS total_gap_ms FROM max_gaps GROUP BY caller"
_CALLS = "SELECT unique_id, start_ts, end_ts, caller, callee, disposition, imei, row_id FROM calls"
_CALL_PAIRS = "SELECT unique_id, start_ts, end_ts, caller, callee, imei FROM call_pairs"
_TOWER_PAIRS = "SELECT unique_id, tower, start_ts, end_ts FROM tower_pairs"

_QUERIES = {
    "connected_calls": "SELECT caller, start_ts AS call_start_ts, end_ts AS call_end_ts "
    "FROM calls WHERE disposition = 'connected'",
    "q2_overlap": _OVERLAP,
    "q2_overlap_sql": _OVERLAP,
    "q2_overlap_tolerant": _OVERLAP_TOLERANT,
    "q2_overlap_bounded": _OVERLAP_BOUNDED,
    "q2_overlap_events_minmax": _OVERLAP_MINMAX,
    "q2_overlap_events_sessions": _OVERLAP_SESSIONS,
    "q10_gap_lag": _GAP_LAG,
    "q10_gap_sql": _GAP_LAG,
    "q10_gap_seconds": _GAP_SECONDS,
    "q10_gap_running_max": _GAP_MAX,
    "q10_gap_within_day": _GAP_MAX_DAY,
    "q10_gap_events_adjacent": _GAP_ADJACENT,
    "q10_gap_events_last_end": _GAP_LAST_END,
    "q10_gap_pattern": _GAP_PATTERN,
    "gap_clamped": "SELECT caller, prev_end, start_ts AS next_start, "
    "greatest(epoch_ms(start_ts) - epoch_ms(prev_end), 0) AS gap_ms FROM running WHERE prev_end IS NOT NULL",
    "span_to_events_calls": "SELECT * FROM bi_calls",
    "span_to_events_towers": "SELECT * FROM bi_towers",
    "rebuild_calls": "SELECT * FROM call_minmax",
    "rebuild_towers": "SELECT * FROM tower_minmax",
    "pair_calls": _CALL_PAIRS,
    "pair_towers": _TOWER_PAIRS,
    "reconcile_lag_vs_runmax": _RECONCILE,
    "refresh_calls": _CALLS,
    "stream_q2_bounded": _OVERLAP_BOUNDED,
    "stream_q2_tolerant": _OVERLAP_TOLERANT,
    "stream_q2_sessions": _OVERLAP_SESSIONS,
    "stream_q2_sessions_carried": _OVERLAP_SESSIONS,
    "stream_q2_minmax": _OVERLAP_MINMAX,
    "stream_q2_minmax_updates": _OVERLAP_MINMAX,
    "stream_q10_running_max": _GAP_MAX,
    "stream_q10_lag": _GAP_LAG_SHORT,
    "stream_q10_last_end": _GAP_LAST_END,
    "stream_q10_within_day": _GAP_MAX_DAY,
    "stream_q10_running_max_carried": _GAP_MAX,
    "stream_q10_lag_carried": _GAP_LAG,
    "stream_q10_last_end_carried": _GAP_LAST_END,
    "stream_pair_calls": _CALL_PAIRS,
    "stream_match_calls": _CALL_PAIRS,
    "stream_pair_towers": _TOWER_PAIRS,
    "stream_pair_calls_carried": _CALL_PAIRS,
    "stream_pair_towers_carried": _TOWER_PAIRS,
    "csv_towers": "SELECT unique_id, tower, start_ts, end_ts, row_id FROM towers",
    "csv_call_events": "SELECT * FROM bi_calls",
    "csv_tower_events": "SELECT * FROM bi_towers",
    "q10_gap_duration": "SELECT caller, unique_id, epoch_ms(start_ts) - epoch_ms(prev_end) AS duration_ms FROM lag_gaps",
    "stream_q10_events_adjacent": _GAP_ADJACENT,
    "stream_q10_pattern": _GAP_PATTERN,
    "stream_csv_roundtrip": _CALLS,
    "stream_metrics": _METRICS,
    "stream_q2_tolerant_unbounded": _OVERLAP_TOLERANT,
    "stream_q2_tolerant_by_start": _OVERLAP_TOLERANT,
    "stream_rebuild_calls_updated": "SELECT * FROM call_minmax",
    "stream_q2_minmax_upserted": _OVERLAP_MINMAX,
    "stream_late_rows": _LATE,
    "stream_q10_running_max_restarted": _GAP_MAX,
    "stream_gap_totals": _TOTALS,
    "stream_run_time": "SELECT 'connected' AS query, count(*) AS input_rows, true AS timed FROM calls",
}


def oracles() -> dict[str, str]:
    """Equivalent SQL per catalog key."""
    return {name: _INPUT + text for name, text in _QUERIES.items()}
