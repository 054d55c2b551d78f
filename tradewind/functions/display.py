"""Display formats. Numbers are rounded half-even on their decimal value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.functions.numbers import as_column

_EXACT = "decimal(28,7)"


def _scaled(value: Column, divisor: int, digits: int) -> Column:
    return F.bround((value / F.lit(divisor)).cast(_EXACT), digits).cast("string")


def thousands(value) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(F.bround(as_column(value).cast(_EXACT), 0), 0)


def short_number(value) -> Column:
    """Number with K or M suffix; small and negative values in full."""
    value = F.coalesce(as_column(value).cast(_EXACT), F.lit(0).cast(_EXACT))
    return (
        F.when(value >= 1000000, F.concat(_scaled(value, 1000000, 2), F.lit("M")))
        .when(value >= 1000, F.concat(_scaled(value, 1000, 1), F.lit("K")))
        .otherwise(thousands(value))
    )


def baht(value) -> Column:
    return F.concat(F.lit("฿"), short_number(value))


def baht_full(value) -> Column:
    return F.concat(F.lit("฿"), thousands(F.coalesce(as_column(value), F.lit(0))))


def signed_percent(fraction) -> Column:
    """Fraction as percent with an explicit sign and one decimal."""
    value = F.bround((as_column(fraction) * 100).cast(_EXACT), 1)
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("")), value.cast("string"), F.lit("%"))


def plain_percent(fraction) -> Column:
    value = F.bround((as_column(fraction) * 100).cast(_EXACT), 1)
    return F.coalesce(F.concat(value.cast("string"), F.lit("%")), F.lit("-"))


def change_text(percent) -> Column:
    """Change against the previous period; ``percent`` is already multiplied by 100."""
    return F.coalesce(
        F.concat(signed_percent(as_column(percent) / 100), F.lit(" vs prev")), F.lit("No comparison")
    )


def duration(seconds) -> Column:
    """``Xh Ym`` from one hour, ``Ym`` from one minute, else ``Zs``."""
    whole = F.coalesce(F.floor(as_column(seconds)), F.lit(0)).cast("bigint")
    hours, rest = F.floor(whole / 3600), whole % 3600
    minutes = F.floor(rest / 60).cast("bigint").cast("string")
    return (
        F.when(whole >= 3600, F.concat(hours.cast("bigint").cast("string"), F.lit("h "), minutes, F.lit("m")))
        .when(whole >= 60, F.concat(minutes, F.lit("m")))
        .otherwise(F.concat(whole.cast("string"), F.lit("s")))
    )


def shorten(text, length: int) -> Column:
    """The first ``length`` characters and an ellipsis when the text is longer."""
    text = as_column(text)
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def product_label(name, sku, length: int = 40) -> Column:
    """Product name cut to ``length`` with its SKU, or a shortened name when there is no SKU."""
    name, sku = as_column(name), as_column(sku)
    with_sku = F.concat(F.substring(name, 1, length), F.lit("... (SKU: "), sku, F.lit(")"))
    return F.when(sku.isNotNull(), with_sku).otherwise(shorten(name, length + 5))
