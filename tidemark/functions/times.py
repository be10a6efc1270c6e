"""Times as Column expressions: day keys, agreement of spans, date presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
MINUTE = 60_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def day_key(us: Column, offset_minutes: Column) -> Column:
    """The local day ``yyyy-MM-dd`` of an instant in microseconds, at an offset from UTC; null without an instant."""
    local = us + offset_minutes.cast("long") * MINUTE
    return F.date_from_unix_date(F.floor(local / DAY).cast("int")).cast("string")


def event_agreement(a_start: Column, a_end: Column, a_all_day: Column, b_start: Column, b_end: Column, b_all_day: Column, same_day: Column) -> Column:
    """How well two events' times agree, 0 to 1; starts and ends in microseconds, an end may be null."""
    a_to, b_to = F.greatest(F.coalesce(a_end, a_start), a_start), F.greatest(F.coalesce(b_end, b_start), b_start)
    gap = F.abs(a_start - b_start)
    return (
        F.when(a_start.isNull() & b_start.isNull(), F.lit(1.0))
        .when(a_start.isNull() | b_start.isNull() | ~same_day, F.lit(0.0))
        .when(a_all_day & b_all_day, F.lit(1.0))
        .when(a_all_day | b_all_day, F.lit(0.5))
        .when(gap < 1_000_000, F.lit(1.0))
        .when((a_start < b_to) & (b_start < a_to), F.lit(0.8))
        .when(gap <= 15 * MINUTE, F.lit(0.6))
        .otherwise(F.lit(0.0))
    )


def todo_agreement(a: Column, b: Column, same_day: Column) -> Column:
    """The same for to-dos' due times."""
    gap = F.abs(a - b)
    return (
        F.when(a.isNull() & b.isNull(), F.lit(1.0))
        .when(a.isNull() | b.isNull() | (gap > DAY), F.lit(0.0))
        .when(gap < 1_000_000, F.lit(1.0))
        .when(same_day, F.lit(0.8))
        .otherwise(F.lit(0.6))
    )


def moment(family: Column, start: Column, due: Column) -> Column:
    """When an item is: an event's start; a to-do's due time, else its start."""
    return F.when(family == "event", start).otherwise(F.coalesce(due, start))
