"""Text to number, duration and date, as native Columns.

Bad input never fails a job: it becomes 0 (numbers, durations) or null (dates).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.functions.numbers import as_column

# Money is a double, as in the exports; see ``numbers.total`` for how it is summed.
MONEY = "double"

# Plain decimal notation only: rejects nan, infinity and the literal suffixes the JVM would accept.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(text: Column, kind: str) -> Column:
    text = F.trim(text)
    zero = F.lit(0).cast(kind)
    return F.coalesce(F.when(text.rlike(_NUMBER), text).try_cast(kind), zero)


def currency(value, kind: str = "double") -> Column:
    """Currency text to number: drops the baht sign, commas, quotes and blanks."""
    text = as_column(value).cast("string")
    for char in '฿," \t\n\x0b\f\r':  # a third of the time of a pattern
        text = F.replace(text, F.lit(char), F.lit(""))
    return _number(text, kind)


def numeric(value, kind: str = "double") -> Column:
    """Plain number; thousands separators are not accepted and give 0."""
    return _number(as_column(value).cast("string"), kind)


def percent(value) -> Column:
    """Percent text to fraction. Only values above 1 are divided by 100, so "0.5%" stays 0.5."""
    number = _number(F.regexp_replace(as_column(value).cast("string"), "[%,]", ""), "double")
    return F.when(number > 1, number / 100).otherwise(number)


def _unit(value: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(value, pattern, 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def duration_thai(value) -> Column:
    """Seconds of a duration written with Thai hour, minute and second words."""
    value = as_column(value)
    return (
        _unit(value, "([0-9]+)ชั่วโมง") * 3600
        + _unit(value, "([0-9]+)นาที") * 60
        + _unit(value, "([0-9]+)วินาที")
    )


def duration_short(value) -> Column:
    """Seconds of a duration such as ``7h 12min 30s``, in any letter case."""
    value = as_column(value)
    return (
        _unit(value, r"(?i)([0-9]+)\s*h") * 3600
        + _unit(value, r"(?i)([0-9]+)\s*min") * 60
        + _unit(value, r"(?i)([0-9]+)\s*s")
    )


def timestamp_iso(value) -> Column:
    return F.trim(as_column(value)).try_cast("timestamp")


def timestamp_dmy(value) -> Column:
    """``dd/MM/yyyy HH:mm:ss`` with stray tabs; anything else is null."""
    text = F.trim(F.translate(as_column(value), "\t", ""))
    return F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss"))


def timestamp_day_first(value) -> Column:
    """Day-first date, with or without a time, else ISO."""
    text = F.trim(F.translate(as_column(value), "\t", ""))
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d/M/yyyy")),
        F.try_to_timestamp(text, F.lit("d/M/yyyy H:m:s")),
        text.try_cast("timestamp"),
    )


def _date(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


# Date patterns in export file names, per kind of export.
FILE_DATE_PATTERNS = {
    "orders": (r"([0-9]{8})_([0-9]{8})", "yyyyMMdd"),
    "ads": (r"([0-9]{2}_[0-9]{2}_[0-9]{4})-([0-9]{2}_[0-9]{2}_[0-9]{4})", "dd_MM_yyyy"),
    "live": (r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "yyyy-MM-dd"),
    "video": (r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "yyyy-MM-dd"),
}


def file_dates(name, kind: str) -> tuple[Column, Column]:
    """Start and end date found in a file name; both null when the pattern is absent."""
    pattern, layout = FILE_DATE_PATTERNS[kind]
    name = as_column(name)
    start = _date(F.regexp_extract(name, pattern, 1), layout)
    end = start if kind in ("live", "video") else _date(F.regexp_extract(name, pattern, 2), layout)
    both = start.isNotNull() & end.isNotNull()
    return F.when(both, start), F.when(both, end)


def report_range(first_cell, name) -> tuple[Column, Column]:
    """Report range ``yyyy-MM-dd ~ yyyy-MM-dd`` in a sheet's first cell, else a date in the file name."""
    cell, name = F.coalesce(as_column(first_cell), F.lit("")), as_column(name)
    pattern = r"([0-9]{4}-[0-9]{2}-[0-9]{2})\s*~\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"
    digits = F.regexp_replace(
        F.regexp_extract(name, r"([0-9]{4}-?[0-9]{2}-?[0-9]{2})", 1), "-", ""
    )
    fallback = _date(digits, "yyyyMMdd")
    in_cell = cell.rlike(pattern)
    start = F.when(in_cell, _date(F.regexp_extract(cell, pattern, 1), "yyyy-MM-dd"))
    end = F.when(in_cell, _date(F.regexp_extract(cell, pattern, 2), "yyyy-MM-dd"))
    return start.when(~in_cell, fallback), end.when(~in_cell, fallback)
