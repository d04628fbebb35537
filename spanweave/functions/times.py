"""Time arithmetic as column expressions. All times have millisecond precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanweave.schemas import TIMESTAMP_FORMAT


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_time(text: Column | str, pattern: str = TIMESTAMP_FORMAT) -> Column:
    """Text as a timestamp; null where it does not fit the pattern."""
    return F.try_to_timestamp(_col(text), F.lit(pattern))


def millis(ts: Column | str) -> Column:
    """Milliseconds since 1970 (session zone UTC)."""
    return F.unix_millis(_col(ts).cast("timestamp"))


def shift(ts: Column | str, by_ms: int | Column) -> Column:
    """``ts`` moved by a number of milliseconds; the type of ``ts`` is kept."""
    amount = F.lit(by_ms) if isinstance(by_ms, int) else by_ms
    return F.timestamp_add("MILLISECOND", amount, _col(ts))


def gap_ms(earlier: Column | str, later: Column | str) -> Column:
    """Whole milliseconds from ``earlier`` to ``later``."""
    return millis(later) - millis(earlier)


def gap_seconds(earlier: Column | str, later: Column | str) -> Column:
    """Whole seconds from ``earlier`` to ``later``, cut off towards zero."""
    return F.call_function("div", gap_ms(earlier, later), F.lit(1000).cast("long"))


def gap_interval(earlier: Column | str, later: Column | str) -> Column:
    """The difference as a day-to-second interval."""
    return _col(later) - _col(earlier)


def clamped_gap_ms(earlier: Column | str, later: Column | str) -> Column:
    """``gap_ms``, with negative gaps raised to zero."""
    return F.greatest(gap_ms(earlier, later), F.lit(0))
