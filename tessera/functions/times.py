"""Dates and times without a clock: zones, parts, epochs, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def business_day(utc: Column, zone: str) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def day_window(day: Column, zone: str) -> tuple[Column, Column]:
    """[start, end) of the day of `zone` in UTC."""
    start = F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))
    return start, F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_add(day, 1).cast("timestamp_ntz"))


def from_parts(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, pm: Column | None = None) -> Column:
    """A moment from parts, null if there is none such; with pm the hour is of 12."""
    hour = h if pm is None else F.when(h.between(1, 12), h % 12 + F.when(pm, 12).otherwise(0))
    return F.try_make_timestamp_ntz(y, mo, d, hour, mi, s)


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC of +hh:mm, -hhmm or Z."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    size = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    return F.when(F.upper(text) == "Z", 0).otherwise(F.when(text.startswith("-"), -size).otherwise(size))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 to the nearest, halves away from 1970, as the SQL twins' epoch_ms; unix_millis cuts them off."""
    us = F.unix_micros(ts.cast("timestamp"))
    half = F.when(us < 0, -500).otherwise(500)
    return F.call_function("div", us + half, F.lit(1000))


def previous_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts) - F.expr("INTERVAL 1 HOUR")


def object_key(prefix: str, hour: Column) -> Column:
    return F.concat(F.lit(prefix), F.date_format(hour, "/'year='yyyy/'month='MM/'day='dd/'orders_'yyyyMMdd_HH'.csv'"))
