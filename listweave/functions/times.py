"""Tolerant reading of ISO times and the two recency tests.

A row whose time is missing or unreadable is never old.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of ISO 8601 that are read, in their extended and basic spelling.
_DAY = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?)"
_SECOND = r"\d{2}(?:[.,]\d{1,9})?"
_CLOCK = rf"(\d{{2}}(?::\d{{2}}(?::{_SECOND})?|\d{{2}}(?:{_SECOND})?)?)"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2})?)?"
ISO_DATE = f"^{_DAY}$"
# The usual forms, which a plain cast reads.
_PLAIN_DATE = r"^\d{4}-\d{2}-\d{2}$"
_PLAIN_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})?)?$"
)
ISO_TIMESTAMP = f"^{_DAY}(?:[T ]{_CLOCK}{_ZONE})?$"


def _day(text: Column) -> Column:
    """Date of one of the forms of ``_DAY``, null if there is no such day."""
    digits = F.regexp_replace(text, "-", "")
    year = F.left(digits, F.lit(4)).cast("int")
    # The week that has the 4th of January is the first one.
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    week = F.substring(digits, 6, 2).cast("int")
    weekday = F.coalesce(F.nullif(F.substring(digits, 8, 1), F.lit("")).cast("int"), F.lit(1))
    monday = F.date_add(fourth, (week - 1) * 7 - F.weekday(fourth))
    in_year = (week >= 1) & (F.year(F.date_add(monday, 3)) == year)
    of_week = F.when(in_year, F.date_add(monday, weekday - 1))
    plain = F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")
    return F.when(text.contains("W"), of_week).otherwise(plain)


def _once(text: Column, read: Callable[[Column], Column]) -> Column:
    """``read`` of a text that is worked out once, however often ``read`` names it. A filter would
    otherwise repeat the whole expression behind the text for each of its names."""
    return F.transform(F.array(text), read)[0]


def iso_timestamp(text: Column) -> Column:
    return _once(text, _iso_timestamp)


def _iso_timestamp(text: Column) -> Column:
    """Null unless the whole text is an ISO date or time. The patterns keep out the other forms
    that a plain cast accepts, such as a bare year or a bare time of day. Only what is not in one of
    the usual forms is taken apart."""

    def part(number: int) -> Column:
        return F.regexp_extract(text, ISO_TIMESTAMP, number)

    clock = F.regexp_replace(F.translate(part(2), ",", "."), ":", "")
    digits = F.rpad(F.split_part(clock, F.lit("."), F.lit(1)), 6, "0")
    fraction = F.split_part(F.concat(clock, F.lit(".")), F.lit("."), F.lit(2))
    zone = F.regexp_replace(part(3), ":", "")
    shift = F.when(F.length(zone) > 1, F.rpad(zone, 5, "0")).otherwise(zone)
    spelled = F.concat(
        _day(part(1)).cast("string"),
        F.lit("T"),
        F.regexp_replace(digits, r"(\d\d)(\d\d)(\d\d)", "$1:$2:$3"),
        F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""),
        F.regexp_replace(shift, r"(\d\d)(\d\d)", "$1:$2"),
    )
    return F.when(text.rlike(_PLAIN_TIMESTAMP), text.try_cast("timestamp")).when(
        text.rlike(ISO_TIMESTAMP), spelled.try_cast("timestamp")
    )


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(_PLAIN_DATE), text.try_cast("date")).when(
        text.rlike(ISO_DATE), _day(text)
    )


def cutoff_time(as_of: datetime, days: int | None) -> datetime | None:
    """``days=0`` is a cutoff at ``as_of`` itself, ``None`` is none."""
    if days is None:
        return None
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return as_of.astimezone(timezone.utc) - timedelta(days=days)


def cutoff_date(as_of: datetime, days: int | None) -> date | None:
    moment = cutoff_time(as_of, days)
    return None if moment is None else moment.date()


def _utc_literal(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%dT%H:%M:%S.%fZ")).cast("timestamp")


def older_than_time(text: Column, as_of: datetime, days: int | None) -> Column:
    moment = cutoff_time(as_of, days)
    if moment is None:
        return F.lit(False)
    return F.coalesce(iso_timestamp(text) < _utc_literal(moment), F.lit(False))


def older_than_date(text: Column, as_of: datetime, days: int | None) -> Column:
    day = cutoff_date(as_of, days)
    if day is None:
        return F.lit(False)
    return F.coalesce(iso_date(text) < F.lit(day.isoformat()).cast("date"), F.lit(False))


def newest_first(text: Column) -> Column:
    """Sort value that puts the newest time first and unreadable ones last; for arrival when the
    landed order is unknown."""
    return F.coalesce(-F.unix_micros(iso_timestamp(text)), F.lit(2**63 - 1))


# Seconds of the coarse windows (a day, a week, a month).
DAY_SECONDS = 86400
WEEK_SECONDS = 604800
MONTH_SECONDS = 2592000


def window_seconds(days: Column) -> Column:
    """The coarse window that a request with this many days asks for."""
    return (
        F.when(days <= 1, DAY_SECONDS)
        .when(days <= 7, WEEK_SECONDS)
        .otherwise(MONTH_SECONDS)
        .cast("bigint")
    )


def ingest_stamp() -> Column:
    """Start of the running query in UTC, seconds precision: ``2026-03-30T10:00:00+00:00``."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")
