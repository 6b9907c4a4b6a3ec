"""Zone-less dates and human-readable amounts. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_until(day: Column, now: Column) -> Column:
    return F.datediff(day, F.to_date(now))


def is_past(starts: Column, ends: Column, now: Column) -> Column:
    """A date alone lasts the whole day; an end before the start is after midnight."""
    start = starts.cast("timestamp_ntz")
    day = F.make_interval(days=F.lit(1))
    until = F.when(ends.isNull(), F.to_date(starts).cast("timestamp_ntz") + day).when(ends < start, ends + day).otherwise(ends)
    return until <= now


def set_seconds(start: Column, end: Column) -> Column:
    """Between two times of a day, in seconds; not after the start means after midnight."""
    s = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.when(s <= 0, s + 86400).otherwise(s)


def needs_music(planned: Column, songs: Column, remind: Column, days: Column) -> Column:
    return planned & (songs <= 0) & (remind > 0) & days.between(F.lit(0), remind)


def month_weeks(first: Column) -> Column:
    """The Mondays of a month's weeks: four, and more while they lie in the month."""
    monday = F.date_sub(first, F.weekday(first))
    weeks = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda w: F.date_add(monday, w * 7))
    return F.filter(weeks, lambda d, i: (i < 4) | (F.month(d) == F.month(first)))


def byte_text(b: Column) -> Column:
    return F.when(b < 1000, F.format_string("%.0f B", b)).when(b < 1e6, F.format_string("%.1f kB", F.floor(b / 100 + 0.5) / 10)).otherwise(F.format_string("%.1f MB", F.floor(b / 1e5 + 0.5) / 10))


def clock_text(s: Column) -> Column:
    part = lambda d: F.lpad((F.floor(s / d).cast("long") % 60).cast("string"), 2, "0")
    return F.concat_ws(":", F.floor(s / 3600).cast("long").cast("string"), part(60), part(1))
