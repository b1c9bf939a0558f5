"""Dates in several notations, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import narrow_digits, strip

#: One pattern for all notations, so that a text is matched once: year first, day first with dots, eight digits, anything else.
_NOTATIONS = (
    r"^(?:(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?(?:[T ]?\d{1,2}[:时].*)?"
    r"|(\d{1,2})\.(\d{1,2})\.(\d{4})(?:[T ].*)?"
    r"|(\d{4})(\d{2})(\d{2})"
    r"|[\s\S]*)$"
)
#: Its groups as year-month-day; groups that did not take part are empty.
_ISO = "$1$6$7-$2$5$8-$3$4$9"
_SERIAL = r"^(\d{1,6})(?:\.\d+)?$"
#: Day 0 of the day counts that spreadsheets keep, in days before 1970-01-01.
_SHEET_EPOCH = 25569


def parse_day(c: Column) -> Column:
    """A date from text, or null where the text is blank or no calendar date.

    Day first with dots, otherwise year first (``2024-5-3``, ``2024/05/03``, ``2024年5月3日``,
    ``20240503``, with or without a time of day); a bare number of up to six digits is a
    spreadsheet's day count. Days that no calendar has (30 February) give null.
    """
    s = strip(narrow_digits(c))
    written = F.regexp_replace(s, _NOTATIONS, _ISO).try_cast("date")
    serial = F.when(s.rlike(_SERIAL), F.date_from_unix_date(F.regexp_extract(s, _SERIAL, 1).try_cast("int") - F.lit(_SHEET_EPOCH)))
    return F.coalesce(written, serial)


def time_of_day(c: Column) -> Column:
    """``HH:mm:ss`` behind the date in a text, or an empty string; it orders moments of one day."""
    time = F.regexp_extract(narrow_digits(F.coalesce(c, F.lit(""))), r"[T ](\d{1,2}:\d{2}(?::\d{2})?)", 1)
    return F.when(F.substring(time, 2, 1) == ":", F.concat(F.lit("0"), time)).otherwise(time)


def zone_millis(c: Column, zone: str = "Asia/Shanghai") -> Column:
    """Epoch milliseconds of a wall-clock text in a zone, seconds optional; a number above 1e11 is taken as such."""
    s = strip(c)
    number = F.when(s.rlike(r"^\d{12,}$"), s.try_cast("long"))
    local = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm")))
    return F.coalesce(number, F.unix_millis(F.to_utc_timestamp(local, zone)))


def year_before(day: Column) -> Column:
    """The same day a year before; of 29 February the 28th."""
    return F.add_months(day, -12)
