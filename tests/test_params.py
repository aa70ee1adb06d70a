from __future__ import annotations

import datetime as dt

import pytest

from tillwise.functions.dates import default_preset, non_negative, parse_day, preset_range, shift_months

DAY = "2001-08-02"


@pytest.mark.parametrize(
    "preset, start",
    [("30", "2001-07-03"), ("90", "2001-05-04"), ("365", "2000-08-02"), ("ytd", "2001-01-01")],
)
def test_presets_end_today(preset, start):
    assert preset_range(preset, DAY) == (dt.date.fromisoformat(start), dt.date(2001, 8, 2))


def test_all_and_custom():
    assert preset_range("all", DAY) == (None, None)
    assert preset_range("custom", DAY, "2001-01-05", "2001-02-06") == (dt.date(2001, 1, 5), dt.date(2001, 2, 6))
    assert preset_range("custom", DAY, "2001-01-05", None) == (None, None)
    with pytest.raises(ValueError):
        preset_range("7", DAY)


def test_unknown_default_is_a_year():
    assert [default_preset(v) for v in ("30", "90", "365", "all", "ytd", "", None)] == [
        "30", "90", "365", "all", "365", "365", "365"]


def test_dates_must_be_real():
    assert parse_day("") is None and parse_day(None) is None
    assert parse_day("2000-02-29") == dt.date(2000, 2, 29)
    for bad in ("2001-02-29", "2001-13-01", "yesterday", "2001-1", 20010101):
        with pytest.raises(ValueError):
            parse_day(bad)


def test_counts_must_not_be_negative():
    assert non_negative("limit", 0) == 0
    for bad in (-1, 1.5, "3", None, True):
        with pytest.raises(ValueError):
            non_negative("limit", bad)


def test_month_arithmetic_clamps():
    assert shift_months(dt.date(2001, 3, 31), -1) == dt.date(2001, 2, 28)
    assert shift_months(dt.date(2000, 12, 31), 2) == dt.date(2001, 2, 28)
    assert shift_months(dt.date(2001, 1, 15), -13) == dt.date(1999, 12, 15)
