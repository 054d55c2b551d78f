from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tradewind.functions import display, parsing


def _apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function("v")).collect()]


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (parsing.currency, "฿1,234.56", 1234.56),
        (parsing.currency, '"1,234.56"', 1234.56),
        (parsing.currency, "-5", -5.0),
        (parsing.currency, "1e3", 1000.0),
        (parsing.currency, "abc", 0.0),
        (parsing.currency, "1d", 0.0),
        (parsing.currency, "nan", 0.0),
        (parsing.currency, "inf", 0.0),
        (parsing.currency, "", 0.0),
        (parsing.currency, None, 0.0),
        (parsing.percent, "15.5%", 0.155),
        (parsing.percent, "0.155", 0.155),
        (parsing.percent, "1%", 1.0),
        (parsing.percent, "0.5%", 0.5),
        (parsing.percent, None, 0.0),
        (parsing.numeric, "1,234", 0.0),
        (parsing.numeric, " 12.5 ", 12.5),
        (parsing.duration_thai, "4ชั่วโมง9นาที28วินาที", 14968),
        (parsing.duration_thai, "9นาที", 540),
        (parsing.duration_thai, "28วินาที", 28),
        (parsing.duration_thai, "", 0),
        (parsing.duration_thai, None, 0),
        (parsing.duration_short, "7h 12min", 25920),
        (parsing.duration_short, "45min 30s", 2730),
        (parsing.duration_short, "2H", 7200),
        (parsing.timestamp_dmy, "19/02/2026 09:10:25\t", datetime(2026, 2, 19, 9, 10, 25)),
        (parsing.timestamp_dmy, "bad", None),
        (parsing.timestamp_day_first, "5/2/2026", datetime(2026, 2, 5)),
        (parsing.timestamp_day_first, "2026-02-05", datetime(2026, 2, 5)),
        (parsing.timestamp_day_first, "Total", None),
    ],
)
def test_text(spark, function, text, expected):
    assert _apply(spark, function, [text]) == [expected]


@pytest.mark.parametrize(
    "kind, name, start, end",
    [
        ("orders", "Order.all.20240101_20240131.xlsx", date(2024, 1, 1), date(2024, 1, 31)),
        ("orders", "Order.all.20249901_20240131.xlsx", None, None),
        ("ads", "report-Ads-01_01_2026-31_01_2026.csv", date(2026, 1, 1), date(2026, 1, 31)),
        ("live", "overview-v2_1m_2026-01-31_x.csv", date(2026, 1, 31), date(2026, 1, 31)),
        ("video", "export.csv", None, None),
    ],
)
def test_file_dates(spark, kind, name, start, end):
    row = spark.createDataFrame([(name,)], "n string").select(*parsing.file_dates("n", kind)).first()
    assert tuple(row) == (start, end)


@pytest.mark.parametrize(
    "cell, name, start, end",
    [
        ("ช่วงวันที่: 2026-01-01 ~ 2026-01-31", "x.xlsx", date(2026, 1, 1), date(2026, 1, 31)),
        ("no range", "Live_20260131.xlsx", date(2026, 1, 31), date(2026, 1, 31)),
        (None, "Live.xlsx", None, None),
    ],
)
def test_report_range(spark, cell, name, start, end):
    df = spark.createDataFrame([(cell, name)], "c string, n string")
    assert tuple(df.select(*parsing.report_range("c", "n")).first()) == (start, end)


def test_display(spark):
    df = spark.createDataFrame([(1234567.0,), (12345.0,), (999.4,), (-12345.0,), (None,)], "v double")
    rows = df.select(display.baht("v"), display.short_number("v")).collect()
    assert [r[0] for r in rows] == ["฿1.23M", "฿12.3K", "฿999", "฿-12,345", "฿0"]
    seconds = spark.range(1).select(
        *[display.duration(F.lit(x)) for x in (3 * 3600 + 125, 125, 59)], display.change_text(F.lit(None).cast("double"))
    )
    assert list(seconds.first()) == ["3h 2m", "2m", "59s", "No comparison"]
