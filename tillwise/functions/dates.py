"""Dates: parameter validation, ranges, presets and month columns.

Range predicates are always written as plain comparisons on the stored column
(never on a function of it), so they reach the file scan.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Day = dt.date | str | None

PRESETS = ("all", "30", "90", "365", "ytd", "custom")
DEFAULT_PRESETS = ("30", "90", "365", "all")

# Metadata key of a timestamp column: the column that names its source's folders by month.
MONTH_COLUMN = "month_column"


def parse_day(value: Day) -> dt.date | None:
    """Validate a date parameter. Empty means "no bound"."""
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    except (TypeError, ValueError) as exc:
        raise ValueError(f"not a calendar date (YYYY-MM-DD): {value!r}") from exc


def required_day(value: Day) -> dt.date:
    day = parse_day(value)
    if day is None:
        raise ValueError("as_of is required")
    return day


def non_negative(name: str, value: int) -> int:
    """Validate a count parameter (limit, days, months)."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be a non-negative integer, got {value!r}")
    return value


def shift_months(day: dt.date, months: int) -> dt.date:
    """Calendar month arithmetic, clamped to the last day of the month."""
    year, month0 = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = calendar.monthrange(year, month0 + 1)[1]
    return dt.date(year, month0 + 1, min(day.day, last))


def shift_days(day: dt.date, days: int) -> dt.date:
    return day + dt.timedelta(days=days)


def first_of_month(day: dt.date) -> dt.date:
    return day.replace(day=1)


def default_preset(value: str | None) -> str:
    """Stored default range: anything unknown falls back to twelve months."""
    return value if value in DEFAULT_PRESETS else "365"


def preset_range(
    preset: str, as_of: Day, start: Day = None, end: Day = None
) -> tuple[dt.date | None, dt.date | None]:
    """Turn a named range into (start, end).

    ``custom`` passes ``start``/``end`` through, but only when both are given:
    half-open custom ranges mean "all time".
    """
    today = required_day(as_of)
    if preset == "all":
        return None, None
    if preset == "30":
        return shift_days(today, -30), today
    if preset == "90":
        return shift_days(today, -90), today
    if preset == "365":
        return shift_months(today, -12), today
    if preset == "ytd":
        return today.replace(month=1, day=1), today
    if preset == "custom":
        first, last = parse_day(start), parse_day(end)
        return (first, last) if first and last else (None, None)
    raise ValueError(f"unknown range preset {preset!r}; expected one of {PRESETS}")


def at(day: dt.date) -> Column:
    """Midnight of ``day`` as a timestamp literal in the session time zone."""
    return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp")


def month_number(column: Column) -> Column:
    """Year and month as an INT such as 200107."""
    return F.year(column) * 100 + F.month(column)


def _in_months(df: DataFrame, column: str, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Keep the folders of the months from ``first`` to ``last``, where the source is laid out by month.

    The column's metadata names the column of the folders. It is not among the
    selected columns, but filters may refer to it all the same.
    """
    month = df.schema[column].metadata.get(MONTH_COLUMN)
    if month is not None:
        if first is not None:
            df = df.filter(F.col(month) >= first.year * 100 + first.month)
        if last is not None:
            df = df.filter(F.col(month) <= last.year * 100 + last.month)
    return df


def within(df: DataFrame, column: str, start: Day, end: Day) -> DataFrame:
    """Inclusive range on a timestamp column of a table.

    ``end`` compares against midnight, so of the end day only 00:00:00 itself
    is included. This is how the reports have always cut their ranges.
    """
    first, last = parse_day(start), parse_day(end)
    df = _in_months(df, column, first, last)
    if first is not None:
        df = df.filter(F.col(column) >= at(first))
    if last is not None:
        df = df.filter(F.col(column) <= at(last))
    return df


def is_within(column: Column, start: Day, end: Day) -> Column:
    """The same range as a flag, for operators that also need the rows outside."""
    first, last = parse_day(start), parse_day(end)
    flag = F.lit(True)
    if first is not None:
        flag = flag & (column >= at(first))
    if last is not None:
        flag = flag & (column <= at(last))
    return flag


def within_months(
    df: DataFrame, column: str, start: Day, end: Day, shift: int = 0
) -> DataFrame:
    """Whole-month range, both months included, as a half-open timestamp range.

    ``shift`` filters on ``column + shift months`` instead. Month bounds are
    first days, so moving them by whole months never clamps.
    """
    first, last = parse_day(start), parse_day(end)
    first = first and shift_months(first_of_month(first), -shift)
    last = last and shift_months(first_of_month(last), -shift)
    df = _in_months(df, column, first, last)
    if first is not None:
        df = df.filter(F.col(column) >= at(first))
    if last is not None:
        df = df.filter(F.col(column) < at(shift_months(last, 1)))
    return df


def month_of(column: str | Column) -> Column:
    return F.date_trunc("month", column)


def month_date(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-01")


def month_label(column: str | Column) -> Column:
    return F.date_format(column, "MMMM yyyy")


def by_month_series(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Final shape of a monthly series: ``date``, ``label``, then the values."""
    return df.select(
        month_date("month").alias("date"), month_label("month").alias("label"), *columns
    ).orderBy("date")
