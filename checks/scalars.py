"""Text functions over text written from the benchmark tables.

The text is built by one SQL expression that both engines understand, so only the functions differ.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import table
from checks.base import Check
from tradewind.functions import display, parsing

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_WHOLE = f"CAST(floor({_CENTS} / 100) AS BIGINT)"
_FRACTION = f"lpad(CAST({_CENTS} % 100 AS VARCHAR(9)), 2, '0')"
_PLAIN = f"concat(CAST({_WHOLE} AS VARCHAR(20)), '.', {_FRACTION})"
_COMMA = (
    f"concat(CAST(CAST(floor({_WHOLE} / 1000) AS BIGINT) AS VARCHAR(20)), ',', "
    f"lpad(CAST({_WHOLE} % 1000 AS VARCHAR(9)), 3, '0'), '.', {_FRACTION})"
)
_CURRENCY = (
    f"CASE l_linenumber WHEN 1 THEN concat('฿', {_COMMA}) WHEN 2 THEN {_COMMA} WHEN 3 THEN concat('-', {_PLAIN}) "
    f"WHEN 4 THEN concat('\"', {_COMMA}, '\"') WHEN 5 THEN concat(' ฿ ', {_PLAIN}, ' ') WHEN 6 THEN concat(l_returnflag, {_PLAIN}) END"
)
_PERCENT_OF = "CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR(9))"
_PERCENT = (
    f"CASE l_linenumber WHEN 1 THEN concat({_PERCENT_OF}, '%') WHEN 2 THEN concat('0.', {_PERCENT_OF}) "
    f"WHEN 3 THEN concat({_PERCENT_OF}, '.5%') WHEN 4 THEN concat('1,0', {_PERCENT_OF}, '%') WHEN 5 THEN l_linestatus "
    f"WHEN 6 THEN concat(' ', {_PERCENT_OF}, ' ') END"
)
_HOURS, _MINUTES = "CAST(l_linenumber AS VARCHAR(9))", "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(9))"
_SECONDS = "CAST(l_partkey % 60 AS VARCHAR(9))"
_THAI = (
    f"CASE l_linenumber WHEN 1 THEN concat({_MINUTES}, 'นาที') WHEN 2 THEN concat({_SECONDS}, 'วินาที') WHEN 3 THEN '' "
    f"WHEN 4 THEN concat({_HOURS}, 'ชั่วโมง', {_SECONDS}, 'วินาที') WHEN 5 THEN NULL "
    f"ELSE concat({_HOURS}, 'ชั่วโมง', {_MINUTES}, 'นาที', {_SECONDS}, 'วินาที') END"
)
_SHORT = (
    f"CASE l_linenumber WHEN 1 THEN concat({_MINUTES}, 'min') WHEN 2 THEN concat({_HOURS}, 'H ', {_MINUTES}, ' MIN') WHEN 3 THEN '-' "
    f"WHEN 4 THEN concat({_MINUTES}, 'min ', {_SECONDS}, 's') WHEN 5 THEN NULL "
    f"ELSE concat({_HOURS}, 'h ', {_MINUTES}, 'min ', {_SECONDS}, 's') END"
)
_DAY_FIRST = "concat(CAST({d} AS VARCHAR(9)), '/', CAST({m} AS VARCHAR(9)), '/', CAST(year(ts) AS VARCHAR(9)))"
_DD, _MM = "lpad(CAST(day(ts) AS VARCHAR(9)), 2, '0')", "lpad(CAST(month(ts) AS VARCHAR(9)), 2, '0')"
_CLOCK = (
    "concat(lpad(CAST(hour(ts) AS VARCHAR(9)), 2, '0'), ':', lpad(CAST(minute(ts) AS VARCHAR(9)), 2, '0'), ':', "
    "lpad(CAST(CAST(floor(second(ts)) AS BIGINT) AS VARCHAR(9)), 2, '0'))"
)
_DMY = f"concat({_DAY_FIRST.format(d=_DD, m=_MM)}, ' ', {_CLOCK})"
_MOMENT = (
    f"CASE event_type WHEN 'view' THEN concat({_DMY}, chr(9)) WHEN 'click' THEN concat(' ', {_DMY}) "
    f"WHEN 'purchase' THEN {_DMY} WHEN 'signup' THEN props END"
)
_Y = "CAST(year(o_orderdate) AS VARCHAR(9))"
_M, _D = "lpad(CAST(month(o_orderdate) AS VARCHAR(9)), 2, '0')", "lpad(CAST(day(o_orderdate) AS VARCHAR(9)), 2, '0')"
_FILE = (
    f"CASE o_orderstatus WHEN 'F' THEN concat('Order.all.', {_Y}, {_M}, '01_', {_Y}, {_M}, {_D}, '.xlsx') "
    f"WHEN 'O' THEN concat('report-Ads-01_', {_M}, '_', {_Y}, '-', {_D}, '_', {_M}, '_', {_Y}, '.csv') "
    f"ELSE concat('overview-v2_1m_', {_Y}, '-', {_M}, '-', {_D}, '_', CAST(o_custkey AS VARCHAR(20)), '.csv') END"
)
_AMOUNT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 200000 AS DECIMAL(18,2))"


def _text(spark, folder, name, expression, *keys):
    return table(spark, folder, name).select(*keys, F.expr(expression).alias("Text"))


def _lines(expression):
    return f"(SELECT l_orderkey, l_linenumber, l_partkey, {expression} AS \"Text\" FROM lineitem)"


_KEYS = ("l_orderkey", "l_linenumber", "l_partkey")
_COLUMNS = "l_orderkey:l l_linenumber:i l_partkey:l Text:s"


def _clean(pattern: str) -> str:
    return f"regexp_replace(\"Text\", '{pattern}', '', 'g')"


def _part(pattern: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract(\"Text\", '{pattern}', 1) AS BIGINT), 0)"


def _seconds(hours: str, minutes: str, seconds: str) -> str:
    return f'{_part(hours)} * 3600 + {_part(minutes)} * 60 + {_part(seconds)} AS "Seconds"'


def _formats(spark, folder):
    orders = table(spark, folder, "orders").withColumn("Amount", F.expr(_AMOUNT))
    fraction = F.col("Amount") / 1000000
    return orders.select(
        "o_orderkey",
        display.baht("Amount").alias("Baht"),
        display.short_number(F.col("Amount") * 10).alias("Short_Number"),
        display.thousands("Amount").alias("Thousands"),
        display.signed_percent(fraction).alias("Signed"),
        display.plain_percent(fraction).alias("Plain"),
        display.duration(F.col("o_custkey") * 7).alias("Duration"),
        display.shorten(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus"), 10).alias("Short_Text"),
        display.product_label(
            F.concat("o_orderpriority", F.lit(" product name that is long enough to be cut")),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
        ).alias("Label"),
    )


def _short_sql(value: str) -> str:
    return (
        f"CASE WHEN {value} >= 1000000 THEN printf('%.2f', round_even(CAST({value} AS DOUBLE) / 1000000, 2)) || 'M' "
        f"WHEN {value} >= 1000 THEN printf('%.1f', round_even(CAST({value} AS DOUBLE) / 1000, 1)) || 'K' "
        f"ELSE format('{{:,}}', CAST(round_even(CAST({value} AS DOUBLE), 0) AS BIGINT)) END"
    )


_RATE = "round_even(CAST(\"Amount\" AS DOUBLE) / 10000, 1)"
_FORMATS = f"""SELECT o_orderkey, '฿' || {_short_sql('"Amount"')} AS "Baht", {_short_sql('("Amount" * 10)')} AS "Short_Number",
  format('{{:,}}', CAST(round_even(CAST("Amount" AS DOUBLE), 0) AS BIGINT)) AS "Thousands",
  CASE WHEN {_RATE} >= 0 THEN '+' || printf('%.1f', abs({_RATE})) ELSE printf('%.1f', {_RATE}) END || '%' AS "Signed",
  printf('%.1f', CASE WHEN {_RATE} = 0 THEN 0 ELSE {_RATE} END) || '%' AS "Plain",
  CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END AS "Duration",
  CASE WHEN length(t) > 10 THEN left(t, 10) || '...' ELSE t END AS "Short_Text",
  CASE WHEN o_orderstatus <> 'P' THEN left(p, 40) || '... (SKU: ' || o_orderstatus || ')'
       WHEN length(p) > 45 THEN left(p, 45) || '...' ELSE p END AS "Label"
FROM (SELECT *, {_AMOUNT} AS "Amount", o_custkey * 7 AS s, o_orderpriority || '/' || o_orderstatus AS t,
        o_orderpriority || ' product name that is long enough to be cut' AS p FROM orders)"""


def _file_dates(spark, folder):
    names = _text(spark, folder, "orders", _FILE, "o_orderkey")
    dates = {}
    for kind in ("orders", "ads", "live"):
        start, end = parsing.file_dates("Text", kind)
        dates |= {f"{kind}_Start": start, f"{kind}_End": end}
    return names.withColumns(dates)


def _date_sql(group_pattern: str, group: int, layout: str) -> str:
    return f"CAST(try_strptime(regexp_extract(\"Text\", '{group_pattern}', {group}), '{layout}') AS DATE)"


_O, _A, _L = "([0-9]{8})_([0-9]{8})", "([0-9]{2}_[0-9]{2}_[0-9]{4})-([0-9]{2}_[0-9]{2}_[0-9]{4})", "([0-9]{4}-[0-9]{2}-[0-9]{2})"

CHECKS = [
    Check(
        "scalar_currency",
        f"{_COLUMNS} Value:f4",
        lambda s, f: _text(s, f, "lineitem", _CURRENCY, *_KEYS).withColumn("Value", parsing.currency("Text")),
        f"SELECT *, coalesce(TRY_CAST({_clean('[฿,\"\\s]')} AS DOUBLE), 0) AS \"Value\" FROM {_lines(_CURRENCY)}",
    ),
    Check(
        "scalar_percent",
        f"{_COLUMNS} Value:f6",
        lambda s, f: _text(s, f, "lineitem", _PERCENT, *_KEYS).withColumn("Value", parsing.percent("Text")),
        f"""SELECT *, CASE WHEN v > 1 THEN v / 100 ELSE v END AS "Value"
            FROM (SELECT *, coalesce(TRY_CAST(trim({_clean("[%,]")}) AS DOUBLE), 0) AS v FROM {_lines(_PERCENT)})""",
    ),
    Check(
        "scalar_duration_thai",
        f"{_COLUMNS} Seconds:l",
        lambda s, f: _text(s, f, "lineitem", _THAI, *_KEYS).withColumn("Seconds", parsing.duration_thai("Text")),
        f"SELECT *, {_seconds('([0-9]+)ชั่วโมง', '([0-9]+)นาที', '([0-9]+)วินาที')} FROM {_lines(_THAI)}",
    ),
    Check(
        "scalar_duration_short",
        f"{_COLUMNS} Seconds:l",
        lambda s, f: _text(s, f, "lineitem", _SHORT, *_KEYS).withColumn("Seconds", parsing.duration_short("Text")),
        f"SELECT *, {_seconds('(?i)([0-9]+)\\s*h', '(?i)([0-9]+)\\s*min', '(?i)([0-9]+)\\s*s')} FROM {_lines(_SHORT)}",
    ),
    Check(
        "scalar_numeric",
        f"{_COLUMNS} Value:f4",
        lambda s, f: _text(s, f, "lineitem", _CURRENCY, *_KEYS).withColumn("Value", parsing.numeric("Text")),
        f'SELECT *, coalesce(TRY_CAST(trim("Text") AS DOUBLE), 0) AS "Value" FROM {_lines(_CURRENCY)}',
    ),
    Check(
        "scalar_dates",
        "event_id:l Text:s Moment:t Day:d",
        lambda s, f: _text(s, f, "events", _MOMENT, "event_id").withColumns(
            {"Moment": parsing.timestamp_dmy("Text"), "Day": F.to_date(parsing.timestamp_day_first("Text"))}
        ),
        f"""SELECT *, CAST("Moment" AS DATE) AS "Day" FROM (
              SELECT *, try_strptime(trim(replace("Text", chr(9), '')), '%d/%m/%Y %H:%M:%S') AS "Moment"
              FROM (SELECT event_id, {_MOMENT} AS "Text" FROM events))""",
    ),
    Check(
        "scalar_file_dates",
        "o_orderkey:l Text:s orders_Start:d orders_End:d ads_Start:d ads_End:d live_Start:d live_End:d",
        _file_dates,
        f"""SELECT *, {_date_sql(_O, 1, "%Y%m%d")} AS "orders_Start", {_date_sql(_O, 2, "%Y%m%d")} AS "orders_End",
              {_date_sql(_A, 1, "%d_%m_%Y")} AS "ads_Start", {_date_sql(_A, 2, "%d_%m_%Y")} AS "ads_End",
              {_date_sql(_L, 1, "%Y-%m-%d")} AS "live_Start", {_date_sql(_L, 1, "%Y-%m-%d")} AS "live_End"
            FROM (SELECT o_orderkey, {_FILE} AS "Text" FROM orders)""",
    ),
    Check(
        "scalar_formats",
        "o_orderkey:l Baht:s Short_Number:s Thousands:s Signed:s Plain:s Duration:s Short_Text:s Label:s",
        _formats,
        _FORMATS,
    ),
]
