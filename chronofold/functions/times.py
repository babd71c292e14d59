"""Timestamps of archive indexes, cohorts, and first-observed texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp14(text: Column) -> Column:
    """The first 14 digits, filled up with zeros; null where they are no time (a bare year has month 00)."""
    digits = F.rpad(F.substring(F.regexp_replace(text, "[^0-9]", ""), 1, 14), 14, "0")
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))


def memento_time(text: Column) -> Column:
    """"Mon, 05 Feb 2024 10:11:12 GMT", whatever the weekday says; or digits alone."""
    shaped = text.rlike(r"^(?i)(mon|tue|wed|thu|fri|sat|sun), [0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2} (GMT|UTC)$")
    day = F.initcap(F.regexp_extract(text, r"^\w{3}, (\d{1,2} \w{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2})", 1))
    return F.when(shaped, F.try_to_timestamp(day, F.lit("d MMM yyyy H:m:s"))).when(F.trim(text).rlike("^[0-9]+$"), timestamp14(text))


def cohort(year: Column) -> Column:
    """Five years, as "2010-2014"; "unknown" without a number in the first four characters."""
    y = F.substring(F.trim(F.coalesce(year, F.lit(""))), 1, 4).try_cast("int")
    first = (F.floor(y / 5) * 5).cast("int")
    return F.when(y.isNull(), "unknown").otherwise(F.concat_ws("-", first, first + 4))


def first_observed(year: Column, run_ts: datetime) -> Column:
    """New Year of the year as text; the run's time where there is no year."""
    y = F.substring(F.trim(F.coalesce(year, F.lit(""))), 1, 4).try_cast("int")
    start = F.when(y.between(1, 9999), F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-01-01T00:00:00+00:00")))
    return F.coalesce(start, F.lit(run_ts.isoformat()))


def established_year(text: Column) -> Column:
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike("^[0-9]+$"), trimmed.try_cast("int"))


def micros(t: Column) -> Column:
    """Microseconds of a time with or without zone, for ordering."""
    return F.unix_micros(t.cast("timestamp"))
