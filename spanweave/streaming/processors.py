"""Keyed state for streams: processors for gaps, for pairing events into spans, for first and last
events, and for joining two sides that lie close in time.

A processor works on a bucket of keys and on whole columns: the rows of a bucket in a
micro-batch are sorted, folded and compared by vector operations, and no loop runs over rows or
keys. The state of a bucket is one entry, its keys and values as an Arrow batch: each call to
the state store costs milliseconds, so a bucket is read once and written once per micro-batch that
touches it, however many keys it holds.

Expiry: a bucket has one event-time timer at most, at the time its oldest value is due, rounded up
to a fraction of the keeping time. When it fires, what is due is dropped and the timer set
for the rest. So a bucket wakes at most ``SLOTS`` times in the time a value is kept, and a
key is passed over that often at most, however many keys are idle.

All times are whole milliseconds, so no time zone is involved in Python. The size of a
micro-batch is bounded by the source (``maxFilesPerTrigger`` or ``maxBytesPerTrigger``), and with
it what one task may hold. Where one key fills a large part of every batch, use
``spanweave.streaming.carried``, which has the same results and splits hot keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Ship the classes themselves, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the events (kept here, too: this module travels alone).
START = 0
END = 1

# More milliseconds than lie between year 1 and 1970.
_SHIFT = 2**46

#: A value is forgotten at most this fraction of the keeping time after it is due.
SLOTS = 16

#: A session is handed on so long after its last event, as timers fire a little behind the watermark.
CLOSED_AFTER_MS = 2


class _Kept(StatefulProcessor):
    """State of a bucket: a table of keys with ``since_ms``, the time of each value, and more columns."""

    layout: pa.Schema
    keep_ms: int | None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getValueState("kept", "due_ms long, held binary")

    def _load(self) -> tuple[dict[str, np.ndarray], int]:
        """The bucket's values by column, and the time for which its timer is set (0: none)."""
        entry = self._kept.get()
        if entry is None:
            return {n: np.zeros(0, t.to_pandas_dtype()) for n, t in zip(self.layout.names, self.layout.types)}, 0
        held = pa.ipc.read_record_batch(pa.py_buffer(bytes(entry[1])), self.layout)
        return {n: held.column(n).to_numpy(zero_copy_only=False) for n in self.layout.names}, entry[0]

    def _store(self, values: dict[str, np.ndarray], due: int, timers) -> None:
        """Replace the bucket's values; a timer that is set stays, also if the bucket is emptied."""
        since = values["since_ms"]
        if self.keep_ms is not None and len(since) and not due:
            # A timer may not lie before the watermark.
            step = max(1, self.keep_ms // SLOTS)
            due = max(int(since.min()) + self.keep_ms, timers.getCurrentWatermarkInMs()) + 1
            due = -(-due // step) * step
            self._handle.registerTimer(due)
        if not len(since) and not due:
            self._kept.clear()
            return
        held = pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type, from_pandas=True) for f in self.layout], schema=self.layout)
        self._kept.update((due, held.serialize().to_pybytes()))

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        values, _ = self._load()
        left = values["since_ms"] > timerValues.getCurrentWatermarkInMs() - self.keep_ms
        self._store({n: v[left] for n, v in values.items()}, 0, timerValues)
        return iter(())

    def close(self) -> None:
        pass


def _sorted(rows: pd.DataFrame, state: dict[str, np.ndarray], key: str, order: list[str], columns: dict[str, Any]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """State and rows by key and order, the state first: the number of each row's key, and the columns.

    ``columns`` says what a column holds where it comes from the state.
    """
    n = len(state[key])
    both = {
        c: np.concatenate([state[held] if held in state else np.full(n, held, rows[c].dtype), rows[c].to_numpy()])
        for c, held in columns.items()
    }
    group = pd.factorize(both[key], use_na_sentinel=False)[0]
    sequence = np.lexsort((*(both[c] for c in reversed(order)), np.arange(len(group)) >= n, group))
    return group[sequence], {c: v[sequence] for c, v in both.items()}


def _last(group: np.ndarray) -> np.ndarray:
    """Whether a row is the last of its key."""
    return np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)


def _before(group: np.ndarray, values: np.ndarray, missing: Any) -> np.ndarray:
    """The value of the row before, of the same key."""
    out = np.full(len(values), missing, values.dtype)
    out[1:] = np.where(group[1:] == group[:-1], values[:-1], missing)
    return out


def _greatest_so_far(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The greatest value of a key up to each row; -1 is none."""
    levels, rank = np.unique(values, return_inverse=True)
    top = np.maximum.accumulate(group.astype(np.int64) * len(levels) + rank)
    return levels[top - group * len(levels)] if len(levels) else values


def _latest_so_far(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The last value of a key up to each row that is not -1."""
    place = np.arange(len(group))
    first = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), place, 0)) if len(group) else place
    at = np.maximum.accumulate(np.where(values >= 0, place, -1)) if len(group) else place
    return np.where(at >= first, values[at], -1)


class GapProcessor(_Kept):
    """Gap from the remembered end of a caller to each later start.

    Input rows: ``caller``, ``at_ms, tie`` (order), ``start_ms`` and ``end_ms``, of which one
    may be null. ``latest=False`` remembers the greatest end, ``latest=True`` the most recent
    one. ``ttl_ms`` forgets an end that lies so far back and never reports a longer gap.
    """

    layout = pa.schema([("caller", pa.string()), ("since_ms", pa.int64())])
    output_schema = "caller string, prev_end_ms long, next_start_ms long, gap_ms long"

    def __init__(self, latest: bool, ttl_ms: int | None = None):
        self.latest = latest
        self.keep_ms = ttl_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        state, due = self._load()
        # Times before 1970 are below zero; shifted, -1 stands for no time.
        rows = rows.assign(**{c: rows[c].fillna(-1 - _SHIFT).astype("int64") + _SHIFT for c in ("start_ms", "end_ms")})
        state["end_ms"] = state["since_ms"] + _SHIFT
        group, both = _sorted(rows, state, "caller", ["at_ms", "tie"], {"caller": "caller", "at_ms": 0, "tie": 0, "start_ms": -1, "end_ms": "end_ms"})
        seen = (_latest_so_far if self.latest else _greatest_so_far)(group, both["end_ms"])
        prev = _before(group, seen, -1)
        gap = both["start_ms"] - prev
        found = (prev >= 0) & (both["start_ms"] >= 0) & (gap > 0)
        if self.keep_ms is not None:
            found &= gap <= self.keep_ms
        last = _last(group) & (seen >= 0)
        self._store({"caller": both["caller"][last], "since_ms": seen[last] - _SHIFT}, due, timerValues)
        yield pd.DataFrame(
            {
                "caller": both["caller"][found],
                "prev_end_ms": prev[found] - _SHIFT,
                "next_start_ms": both["start_ms"][found] - _SHIFT,
                "gap_ms": gap[found],
            }
        )


class PairProcessor(_Kept):
    """A span for each END whose preceding event of the same id is a START.

    Input rows: ``unique_id``, ``ts_ms, row_id`` (order), ``event_type`` and the columns to
    carry. ``start_fields`` are taken from the START and kept in the state, ``end_fields``
    from the END. ``keep_ms`` forgets an open START after that time and leaves out longer
    spans. The output column ``end_ts`` is the event time, for operators that follow.
    """

    def __init__(self, start_fields: dict[str, str], end_fields: dict[str, str], keep_ms: int | None = None):
        self.start_fields = tuple(start_fields)
        self.end_fields = tuple(end_fields)
        self.keep_ms = keep_ms
        kinds = {"string": pa.string(), "long": pa.int64()}
        self.layout = pa.schema([("unique_id", pa.int64()), ("since_ms", pa.int64()), *((n, kinds[t]) for n, t in start_fields.items())])
        carried = {**start_fields, **end_fields}
        self.output_schema = ", ".join(
            ["unique_id long", "start_ms long", "end_ts timestamp", *(f"{n} {t}" for n, t in carried.items())]
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        rows = rows[rows["event_type"].isin([START, END])]
        state, due = self._load()
        columns = {"unique_id": "unique_id", "ts_ms": "since_ms", "row_id": -1, "event_type": START}
        columns |= {f: f for f in self.start_fields} | {f: None for f in self.end_fields}
        rows = rows.astype({f: object for f in self.end_fields})
        group, both = _sorted(rows, state, "unique_id", ["ts_ms", "row_id"], columns)
        starts = both["event_type"] == START
        ends = np.flatnonzero(~starts & _before(group, starts, False))
        if self.keep_ms is not None:
            ends = ends[both["ts_ms"][ends] - both["ts_ms"][ends - 1] <= self.keep_ms]
        opened = _last(group) & starts
        self._store({"since_ms": both["ts_ms"][opened], **{c: both[c][opened] for c in ("unique_id", *self.start_fields)}}, due, timerValues)
        yield pd.DataFrame(
            {
                "unique_id": both["unique_id"][ends],
                "start_ms": both["ts_ms"][ends - 1],
                "end_ts": pd.to_datetime(both["ts_ms"][ends], unit="ms", utc=True),
                **{f: both[f][ends - 1] for f in self.start_fields},
                **{f: both[f][ends] for f in self.end_fields},
            }
        )


class NearProcessor(_Kept):
    """Pairs of a left and a right row with equal keys whose times lie close together.

    Input rows: the ``keys`` (whole numbers), ``is_right``, ``at_ms`` (the event time) and the
    ``fields`` of either side. A pair is found if ``low_ms <= right - left <= high_ms``, in the
    micro-batch in which its later row arrives. A row is kept until the watermark has passed the time
    in which a partner could come. Output: keys, ``left_ms``, ``right_ms`` and the fields as ``left_...``
    and ``right_...``, of which ``wanted`` names those needed. ``event_time`` adds the right row's
    time as event time, for operators that follow (needs ``low_ms >= 0``).
    """

    #: Pairs are handed on in pieces of about this size, as one key may have very many.
    piece = 200_000

    def __init__(self, keys: list[str], fields: dict[str, str], wanted: list[str], low_ms: int, high_ms: int, event_time: str | None = None):
        self.keys, self.fields, self.wanted = tuple(keys), tuple(fields), tuple(wanted)
        self.low_ms, self.high_ms, self.event_time = low_ms, high_ms, event_time
        self.keep_ms = high_ms - low_ms
        kinds = {"string": pa.string(), "long": pa.int64()}
        self.layout = pa.schema(
            [*((k, pa.int64()) for k in keys), ("is_right", pa.bool_()), ("at_ms", pa.int64()), ("since_ms", pa.int64()), *((n, kinds[t]) for n, t in fields.items())]
        )
        out = [*(f"{k} long" for k in keys), "left_ms long", "right_ms long", *(f"{w} {fields[w.partition('_')[2]]}" for w in wanted)]
        self.output_schema = ", ".join([*out, *([f"{event_time} timestamp"] if event_time else [])])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        state, due = self._load()
        n = len(state["at_ms"])
        names = [*self.keys, "is_right", "at_ms", *self.fields]
        both = {c: np.concatenate([state[c], rows[c].to_numpy().astype(state[c].dtype)]) for c in names}
        group = pd.factorize(both[self.keys[0]])[0]
        for k in self.keys[1:]:
            # Numbers stay below the count of rows, so their product cannot overflow.
            group = pd.factorize(group.astype(np.int64) * (len(group) + 1) + pd.factorize(both[k])[0])[0]
        is_new, right, at = np.arange(len(group)) >= n, both["is_right"], both["at_ms"]
        for left_side, right_side in ((~right, right & is_new), (~right & is_new, right & ~is_new)):
            yield from self._found(both, group, np.flatnonzero(left_side), np.flatnonzero(right_side))
        both["since_ms"] = np.where(right, at - self.high_ms, at + self.low_ms)
        left = both["since_ms"] > timerValues.getCurrentWatermarkInMs() - self.keep_ms
        self._store({c: v[left] for c, v in both.items()}, due, timerValues)

    def _found(self, both: dict[str, np.ndarray], group: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(left) or not len(right):
            return
        at = both["at_ms"]
        right = right[np.lexsort((at[right], group[right]))]
        # The right rows and the limits of each left row in one order: how many lie before a limit.
        m, k = len(left), len(right)
        whose = np.concatenate([group[left], group[right], group[left]])
        when = np.concatenate([at[left] + self.low_ms, at[right], at[left] + self.high_ms])
        kind = np.repeat(np.array([0, 1, 2], np.int8), [m, k, m])
        order = np.lexsort((kind, when, whose))
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(kind[order] == 1)
        first, count = before[:m], before[m + k :] - before[:m]
        total = np.cumsum(count)
        begin = 0
        while begin < m:
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + self.piece, side="right")))
            c = count[begin:end]
            le = np.repeat(left[begin:end], c)
            ri = right[np.repeat(first[begin:end] - (np.cumsum(c) - c), c) + np.arange(len(le))]
            begin = end
            if len(le):
                side = {"left": le, "right": ri}
                out = {k: both[k][le] for k in self.keys} | {"left_ms": at[le], "right_ms": at[ri]}
                out |= {w: both[w.partition("_")[2]][side[w.partition("_")[0]]] for w in self.wanted}
                if self.event_time:
                    out[self.event_time] = pd.to_datetime(at[ri], unit="ms", utc=True)
                yield pd.DataFrame(out)


class SpanProcessor(_Kept):
    """First and last event of each session: events of a key no further than ``gap_ms`` apart.

    Input rows: ``unique_id``, the ``names`` (strings) and ``at_ms``, the event time. A session is
    handed on once its last event lies two milliseconds behind the watermark, with that time as event time
    ``closed``: timers fire a millisecond behind the watermark, and what is handed on must not lie before
    the watermark of the micro-batch before.
    """

    keep_ms = 0

    def __init__(self, names: list[str], gap_ms: int):
        self.names, self.gap_ms = tuple(names), gap_ms
        self.layout = pa.schema([("unique_id", pa.int64()), *((n, pa.string()) for n in names), ("first_ms", pa.int64()), ("since_ms", pa.int64())])
        self.output_schema = ", ".join(["unique_id long", *(f"{n} string" for n in names), "first_ms long", "last_ms long", "closed timestamp"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        state, due = self._load()
        keys = ("unique_id", *self.names)
        both = {c: np.concatenate([state[c], rows[c].to_numpy().astype(state[c].dtype)]) for c in keys}
        at = rows["at_ms"].to_numpy()
        first, last = np.concatenate([state["first_ms"], at]), np.concatenate([state["since_ms"], at])
        group = pd.factorize(both["unique_id"])[0]
        for k in self.names:
            group = pd.factorize(group.astype(np.int64) * (len(group) + 1) + pd.factorize(both[k], use_na_sentinel=False)[0])[0]
        order = np.lexsort((first, group))
        group, first, last = group[order], first[order], last[order]
        reached = _greatest_so_far(group, last)
        begins = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (first[1:] - reached[:-1] > self.gap_ms)))
        spans = {c: v[order][begins] for c, v in both.items()}
        yield from self._close(spans | {"first_ms": first[begins], "since_ms": np.maximum.reduceat(last, begins)}, due, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._close(self._load()[0], 0, timerValues)

    def _close(self, spans: dict[str, np.ndarray], due: int, timers) -> Iterator[pd.DataFrame]:
        closed = spans["since_ms"] + CLOSED_AFTER_MS <= timers.getCurrentWatermarkInMs()
        left = {c: v[~closed] for c, v in spans.items()}
        if due and len(left["since_ms"]) and left["since_ms"].min() + 1 < due:
            # An event that came out of order ends before the others.
            self._handle.deleteTimer(due)
            due = 0
        self._store(left, due, timers)
        if closed.any():
            out = {c: v[closed] for c, v in spans.items()}
            out["last_ms"] = out.pop("since_ms")
            yield pd.DataFrame(out | {"closed": pd.to_datetime(out["last_ms"] + CLOSED_AFTER_MS, unit="ms", utc=True)})
