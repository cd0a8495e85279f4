"""Date operators for the mixed-format ``posted`` text.

All functions take an explicit ``as_of`` and use plain arithmetic, so results do
not depend on the clock or on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankfold.functions.text import strip_space
from rankfold.schema import text_or_empty

_FRACTION = r"(?:[.,](?:\d+|(?=[Z+-])))?"   # a bare point may stand before an offset
_CLOCK = (
    rf"(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d{_FRACTION})?|[0-5]\d(?:[0-5]\d{_FRACTION})?)?"
)
_OFFSET = r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d)?)?)"
_TIME_PART = rf"(?:.{_CLOCK}{_OFFSET}?)?"
# a date may also be followed by Z alone
ISO_STAMP = rf"^\d{{4}}(?:-\d{{2}}-\d{{2}}|\d{{4}})(?:Z|{_TIME_PART})$"
USUAL_STAMP = (
    r"^\d{4}-\d{2}-\d{2}(?:Z|.(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d{1,6})?"
    r"(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)?)?$"
)
_OFFSET_AT_END = rf"{_OFFSET}$"   # looked for in the time part only

DAY_MICROS = 86_400_000_000
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def epoch_micros(as_of: datetime) -> int:
    """Exact microseconds since 1970 UTC; a naive value counts as UTC."""
    stamp = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    delta = stamp - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def posted_today(posted: Column, as_of: datetime) -> Column:
    """Relative age, ISO stamp (date in its own offset) or ``Mon DD`` of ``as_of``'s date.

    The date is known when the plan is built, so every accepted form goes into
    one pattern that is compiled once.
    """
    year, month, day = f"{as_of:%Y}", f"{as_of:%m}", f"{as_of:%d}"
    forms = [
        r"(?i:new|today)$",
        r"\d+\s*(?i:[hm])\b",      # hours and minutes, however many
        r"0+\s*(?i:d)\b",
        rf"{year}(?:-{month}-{day}|{month}{day}){_TIME_PART}$",
    ]
    if (as_of.month, as_of.day) != (2, 29):   # a year-less 29 February never parses
        month_name = _MONTHS[as_of.month - 1]
        forms.append(rf"(?i:{month_name})\s+{'0?' if as_of.day < 10 else ''}{as_of.day}$")
    pattern = "(?sU)^(?:" + "|".join(forms) + ")"
    return F.rlike(strip_space(text_or_empty(posted)), F.lit(pattern))


def _number(text: Column, start: int, length: int = 2) -> Column:
    """Digits at a position as a number; missing digits count as zero."""
    return F.coalesce(F.rpad(F.substring(text, start, length), length, "0").try_cast("bigint"), F.lit(0))


def _any_iso_micros(text: Column) -> Column:
    """Microseconds of any accepted form, digit by digit (for the rare compact forms)."""
    extended = F.substring(text, 5, 1) == "-"
    day = F.when(extended, F.substring(text, 1, 10)).otherwise(
        F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    )
    days = F.datediff(day.try_cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    time_part = F.when(extended, F.substring(text, 12, 60)).otherwise(F.substring(text, 10, 60))
    offset = F.regexp_extract(time_part, _OFFSET_AT_END, 0)
    digits = F.regexp_replace(F.regexp_replace(time_part, _OFFSET_AT_END, ""), r"[:.,]", "")
    offset_digits = F.regexp_replace(offset, r"[Z:+-]", "")
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    seconds = _number(digits, 1) * 3600 + _number(digits, 3) * 60 + _number(digits, 5)
    shift = sign * (
        _number(offset_digits, 1) * 3600 + _number(offset_digits, 3) * 60 + _number(offset_digits, 5)
    )
    return (days * 86_400 + seconds - shift) * 1_000_000 + _number(digits, 7, 6)


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO stamp (no offset: UTC); null if it is not one.

    A pattern decides what counts as a stamp, because SQL casts accept more
    (``2026``, ``12:30``).  The usual forms then take the native cast, always
    with an explicit offset, so the session time zone has no part in it.
    """
    day, clock = F.substring(text, 1, 10), F.replace(F.substring(text, 12, 60), F.lit(","), F.lit("."))
    has_offset = F.contains(clock, F.lit("Z")) | F.contains(clock, F.lit("+")) | F.contains(clock, F.lit("-"))
    usual = F.concat(
        day, F.lit("T"), F.when(clock == "", "00:00:00").otherwise(clock), F.when(has_offset, "").otherwise("Z")
    )
    return F.when(
        F.rlike(text, F.lit("(?s)" + USUAL_STAMP)), F.unix_micros(usual.try_cast("timestamp"))
    ).when(F.rlike(text, F.lit("(?s)" + ISO_STAMP)), _any_iso_micros(text))


def is_stale(posted: Column, as_of: datetime, days: int = 30) -> Column:
    """More than ``days`` whole days old; text that is not an ISO stamp is never stale."""
    newest_stale = epoch_micros(as_of) - (days + 1) * DAY_MICROS
    return F.coalesce(iso_micros(text_or_empty(posted)) <= newest_stale, F.lit(False))


def stamp_micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), stamp)


def epoch_ms_to_iso(millis: Column) -> Column:
    """ISO text in UTC of epoch milliseconds; 0 or absent gives ''."""
    within = F.pmod(millis, F.lit(86_400_000).cast("bigint"))
    day = F.date_add(
        F.lit("1970-01-01").cast("date"), F.floor((millis - within) / 86_400_000).cast("int")
    )
    second = F.floor(within / 1000).cast("bigint")
    milli = F.pmod(within, F.lit(1000).cast("bigint"))

    def two(value: Column) -> Column:
        return F.lpad(value.cast("string"), 2, "0")

    text = F.concat(
        day.cast("string"), F.lit("T"),
        two(F.floor(second / 3600)), F.lit(":"),
        two(F.pmod(F.floor(second / 60), F.lit(60))), F.lit(":"),
        two(F.pmod(second, F.lit(60))),
        F.when(milli == 0, "").otherwise(
            F.concat(F.lit("."), F.lpad(milli.cast("string"), 3, "0"), F.lit("000"))
        ),
        F.lit("+00:00"),
    )
    return F.when(millis.isNull() | (millis == 0), "").otherwise(text)


def run_stamp(as_of: datetime) -> str:
    """``YYYYMMDD_HHMMSS``, used in output names."""
    return as_of.strftime("%Y%m%d_%H%M%S")
