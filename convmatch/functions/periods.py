"""Dates, times and periods as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_ok(c: Column) -> Column:
    """A time HH:MM:SS within its bounds; null is not."""
    return F.coalesce(c.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"), F.lit(False))


def relevance_period(start_date: Column, start_time: Column, end_date: Column, end_time: Column, invert: bool = False) -> Column:
    """Text of a period.  ``invert`` takes present times for missing ones and the reverse."""
    has_s, has_e = (~time_ok(start_time), ~time_ok(end_time)) if invert else (time_ok(start_time), time_ok(end_time))
    sd, ed = start_date.cast("string"), end_date.cast("string")
    at = F.lit(" at ")
    same = start_date == end_date
    one_day = (
        F.when(~has_s & ~has_e, sd)
        .when(has_s & has_e & (start_time != end_time), F.concat(sd, F.lit(" from "), start_time, F.lit(" to "), end_time))
        .when(has_s & has_e & (start_time == end_time), F.concat(sd, at, start_time))
        .when(has_e & ~has_s, F.concat(sd, at, end_time))
        .when(has_s & ~has_e, F.concat(sd, at, start_time))
    )
    left = F.when(has_s, F.concat(sd, at, start_time)).otherwise(sd)
    right = F.when(has_e, F.concat(ed, at, end_time)).otherwise(ed)
    return F.coalesce(F.when(same, one_day).when(start_date != end_date, F.concat(left, F.lit(" to "), right)), F.lit("Undefined scenario"))


def range_text(times: Column) -> Column:
    """'Unknown', the one time, or 'from a to b' of an array of strings."""
    d = F.array_distinct(F.array_compact(times))
    two = F.concat(F.lit("from "), F.array_min(d), F.lit(" to "), F.array_max(d))
    return F.when(F.coalesce(F.size(d), F.lit(0)) <= 0, "Unknown").when(F.size(d) == 1, d[0]).otherwise(two)


def date_time(date: Column, time: Column, fallback: Column) -> Column:
    """date + time strings as timestamp, else ``fallback``."""
    return F.coalesce(F.try_to_timestamp(F.concat(date, F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm:ss")), fallback)
