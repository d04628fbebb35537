"""Predicates over spans, as native column expressions.

A comparison with a null time is null, so a filter drops the row, as SQL does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanweave.functions.times import shift
from spanweave.schemas import CONNECTED, END, START


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_connected(disposition: Column | str = "disposition") -> Column:
    return _col(disposition) == CONNECTED


def is_start(event_type: Column | str = "event_type") -> Column:
    return _col(event_type) == START


def is_end(event_type: Column | str = "event_type") -> Column:
    return _col(event_type) == END


def overlaps(a_start, a_end, b_start, b_end, tolerance_ms: int = 0) -> Column:
    """Span ``a`` overlaps span ``b`` widened by ``tolerance_ms`` at both ends.

    Both comparisons are strict: spans that only touch do not overlap.
    """
    b_from, b_to = _col(b_start), _col(b_end)
    if tolerance_ms:
        b_from, b_to = shift(b_from, -tolerance_ms), shift(b_to, tolerance_ms)
    return (_col(a_start) < b_to) & (_col(a_end) > b_from)


def contains(outer_start, outer_end, inner_start, inner_end) -> Column:
    """The inner span lies within the outer one; equal ends count as within."""
    return (_col(inner_start) >= _col(outer_start)) & (_col(inner_end) <= _col(outer_end))


def partly_overlaps(a_start, a_end, b_start, b_end, tolerance_ms: int = 0) -> Column:
    """Span ``a`` overlaps ``b`` (with tolerance) and is not contained in the plain ``b``."""
    return overlaps(a_start, a_end, b_start, b_end, tolerance_ms) & ~contains(
        b_start, b_end, a_start, a_end
    )


def near(ts, anchor, within_ms: int) -> Column:
    """``ts`` lies within ``within_ms`` of ``anchor``, both limits included.

    The limits are interval literals on plain columns, the form from which a stream-stream
    join derives how long it must keep its rows.
    """
    span = F.expr(f"INTERVAL {int(within_ms)} MILLISECONDS")
    return (_col(ts) >= _col(anchor) - span) & (_col(ts) <= _col(anchor) + span)
