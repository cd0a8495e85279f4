from datetime import datetime, timedelta, timezone
from itertools import product

import pytest

from rankfold.functions import dates as dt

AS_OF = datetime(2026, 6, 30, 12, tzinfo=timezone.utc)

CASES = [  # posted, today, stale
    ("", False, False), (None, False, False), ("new", True, False), ("Today", True, False), ("0d", True, False), (" 0d ", True, False),
    ("1d", False, False), ("45d", False, False), ("5h", True, False), ("48h", True, False), ("30m ago", True, False),
    ("1mo", False, False), ("2026-06-30T17:05:44-04:00", True, False), ("2026-06-30T23:30:00-04:00", True, False),
    ("2026-06-30", True, False), ("2026-06-30T10:00:00z", False, False), ("TODAY", True, False), ("5H", True, False), ("5 h", True, False),
    ("5ha", False, False), ("JUN 30", True, False), ("20260630", True, False), ("2026-05-31T12:00:00Z", False, False),
    ("2026-05-30T12:00:00Z", False, True), ("2026-05-30T12:00:01Z", False, False), (" 2026-01-01", False, False),
    ("Jun 30", True, False), ("jun 30", True, False), ("Jun  30", True, False), ("Jun 29", False, False),
    ("June 30", False, False), ("Feb 29", False, False), ("2026", False, False), ("2026-06", False, False),
    ("12:30", False, False), ("2026-13-01", False, False), ("2026-02-30", False, False), ("2025-12-01", False, True),
    ("20251201T101112+0530", False, True), ("2026-06-30 25:00", False, False), ("new grad", False, False),
]


def test_today(many):
    got = many(lambda c: dt.posted_today(c, AS_OF), [c[0] for c in CASES])
    assert dict(zip([c[0] for c in CASES], got)) == {c[0]: c[1] for c in CASES}


def test_stale(many):
    got = many(lambda c: dt.is_stale(c, AS_OF), [c[0] for c in CASES])
    assert dict(zip([c[0] for c in CASES], got)) == {c[0]: c[2] for c in CASES}


def test_one_digit_days_and_leap_day(many):
    assert many(lambda c: dt.posted_today(c, datetime(2026, 7, 4)), ["Jul 4", "jul 04", "Jul 14"]) == [True, True, False]
    assert many(lambda c: dt.posted_today(c, datetime(2024, 2, 29)), ["Feb 29", "2024-02-29"]) == [False, True]


STAMPS = [
    "2026-06-30", "2026-06-30T17:05:44-04:00", "2026-06-30 08:15", "20260630T081530Z", "2026-06-30T08:15:30.25+05:30",
    "2026-06-30T08", "1969-12-31T23:59:59.999999+00:00", "2024-02-29T00:00:00.1234567Z", "2026-06-30x08:15:30", "2026-06-30T08:15:30,5",
    "2026-06-30T00:30:00+14:00", "2026-06-30T08:15:30-00:30",
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_iso_micros_agree_with_python_in_any_session_zone(spark, many, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = many(dt.iso_micros, STAMPS)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    expected = []
    for text in STAMPS:
        stamp = datetime.fromisoformat(text)
        stamp = stamp if stamp.tzinfo else stamp.replace(tzinfo=timezone.utc)
        expected.append((stamp - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1))
    assert got == expected


def test_not_iso(many):
    assert many(dt.iso_micros, ["", "x", "2026-6-30", "2026-06-30T", "2026-06-30T24:00", "2026-0630", "2026-06-30T08:1530", None]) == [None] * 8


def test_epoch_ms_agrees_with_python(many):
    values = [1704067207179, 1704067200000, 1, 951782400000, 0, None]
    expected = [datetime.fromtimestamp(v / 1000, tz=timezone.utc).isoformat() if v else "" for v in values]
    assert many(dt.epoch_ms_to_iso, values, "bigint") == expected


def test_run_stamp():
    assert dt.run_stamp(datetime(2026, 7, 8, 9, 1, 2)) == "20260708_090102"


def test_all_mixes_of_parts_agree_with_python(many):
    """Every mix of parts, valid or not: a stamp exactly when Python reads one, and the same instant."""
    days = ["2026-06-30", "20260630", "2024-02-29", "2023-02-29", "2026-6-3", "2026-13-01", "0001-01-01", "2026-0630", "2026"]
    clocks = ["", "T", "T08", "T08:15", "T0815", "T08:15:30", "T081530", "T08:15:30.5", "T08:15:30,123456", "T08:15:30.1234567",
              " 23:59:59", "x00:00:00", "T24:00:01", "T08:60", "T08:1530", "T0815:30", "T8:15", "T08:15:30."]
    offsets = ["", "Z", "+00:00", "-04:00", "+0530", "+14", "-23:59", "+24:00", "+05:30:15", "+5:30", "z", "-00:30", "+18:30"]
    values = ["".join(parts) for parts in product(days, clocks, offsets)]

    def expected(text):
        try:
            stamp = datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            return None
        stamp = stamp if stamp.tzinfo else stamp.replace(tzinfo=timezone.utc)
        return (stamp - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)

    got = many(dt.iso_micros, values)
    wrong = [(v, g, expected(v)) for v, g in zip(values, got) if g != expected(v)]
    assert not wrong, str(wrong)
