"""Time as Unix microseconds: columns, ranges, expressions and buckets."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
HOUR = UNITS["h"]


def ts_us(column: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    c = F.col(column) if isinstance(column, str) else column
    return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


@dataclass(frozen=True)
class TimeRange:
    """[start, stop) in microseconds."""

    start: int
    stop: int

    def __post_init__(self):
        if self.stop <= self.start:
            raise ValueError("an empty time range")

    def holds(self, ts: str = "ts") -> Column:
        return (F.col(ts) >= self.start) & (F.col(ts) < self.stop)

    def holds_raw(self, column: str) -> Column:
        """The same condition on a timestamp column without zone, in a form that reaches the scan."""
        at = lambda us: F.lit(datetime(1970, 1, 1) + timedelta(microseconds=us)).cast("timestamp_ntz")
        return (F.col(column).cast("timestamp_ntz") >= at(self.start)) & (F.col(column).cast("timestamp_ntz") < at(self.stop))

    def bounds(self, columns: int) -> list[int]:
        """Starts of `columns` equal parts, and the end."""
        return [self.start + (self.stop - self.start) * j // columns for j in range(columns + 1)]

    def column_of(self, previous: Column, ts: Column, columns: int) -> Column:
        """The part that the middle between an observation and the one before falls into; alone, its own time counts."""
        middle = F.greatest(F.coalesce(previous + ((ts - previous) / 2).cast("long"), ts), F.lit(self.start))
        return F.least(F.lit(columns - 1), F.floor((middle - self.start) * columns / (self.stop - self.start))).cast("int")


def parse(text: str, now: int | None = None) -> int:
    """Microseconds of a decimal number of them, an RFC 3339 time with a zone, `now`, or `now-N` with a unit."""
    text = text.strip()
    if re.fullmatch(r"0|-?[1-9]\d*", text):
        return int(text)
    now = time.time_ns() // 1_000 if now is None else now
    if m := re.fullmatch(r"now(?:-(\d+)(us|ms|s|m|h|d|w))?", text):
        return now - int(m[1] or 0) * UNITS[m[2] or "us"]
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError(f"no time zone: {text}")
    return int(at.replace(microsecond=0).timestamp()) * 1_000_000 + at.microsecond


def hour_of(ts: Column) -> Column:
    """Start of the hour, also before 1970."""
    return (F.floor(ts / HOUR) * HOUR).cast("long")
