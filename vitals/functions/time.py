"""Time helpers that work on TIMESTAMP and TIMESTAMP_NTZ alike."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hours_between(start: Column, end: Column) -> Column:
    """``EXTRACT(EPOCH FROM end - start) / 3600.0`` (fractional hours)."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def day_range_filter(ts: Column, start: str | _dt.date, end: str | _dt.date) -> Column:
    """``ts::date BETWEEN start AND end`` as a half-open timestamp range.

    Written on the raw timestamp so Parquet min/max statistics (and a
    partition column derived from the same timestamp) can prune.
    """
    s = _dt.date.fromisoformat(str(start))
    e = _dt.date.fromisoformat(str(end)) + _dt.timedelta(days=1)
    # String literals are coerced to the column's own type (TIMESTAMP or
    # TIMESTAMP_NTZ), so no session-zone shift is introduced.
    return (ts >= F.lit(f"{s.isoformat()} 00:00:00")) & (ts < F.lit(f"{e.isoformat()} 00:00:00"))


def event_day(events: DataFrame) -> Column:
    """UTC day of an event: the partition column of a stored event table (so
    that joins on the day prune its partitions), else taken from the timestamp."""
    return F.col("event_date") if "event_date" in events.columns else F.to_date("created_at")


def filter_days(df, start, end, ts_col: str = "created_at", part_col: str = "event_date"):
    """Rows with ``ts_col::date BETWEEN start AND end``; when the table carries
    the day partition column the same range is applied to it too, so whole
    day partitions are pruned before any file is opened."""
    cond = day_range_filter(F.col(ts_col), start, end)
    if part_col in df.columns:
        s = _dt.date.fromisoformat(str(start))
        e = _dt.date.fromisoformat(str(end))
        cond = cond & F.col(part_col).between(F.lit(s), F.lit(e))
    return df.filter(cond)
