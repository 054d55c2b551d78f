"""Exact positions and quantiles of a global order without sorting everything in one task.

The rows are range-partitioned by the sort keys and written once with the number of their range. One aggregation over
the ranges gives their sizes, and with them the number of rows and the sum; only the ranges that hold a wanted position
are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.session import stage


@dataclass(frozen=True)
class Ranges:
    """Rows in ranges of their order, stored, with the number of rows and the sum of the first key per range."""

    table: DataFrame
    keys: tuple[str, ...]
    sizes: list[tuple[int, int]]
    total: float

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.sizes)


def ranges(df: DataFrame, keys: Sequence[str], weight: str | None = None) -> Ranges:
    """``weight`` names a column with the number of copies a row stands for. The first key is a number."""
    copies = F.col(weight) if weight else F.lit(1).cast("bigint")
    table = stage(
        df.select(*keys, copies.alias("_copies")).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sums = table.groupBy("_range").agg(F.sum("_copies").alias("n"), F.sum(F.col(keys[0]).cast("double") * F.col("_copies")).alias("s"))
    found = sums.orderBy("_range").collect()
    return Ranges(table, tuple(keys), [(r["_range"], r["n"]) for r in found], math.fsum(r["s"] or 0.0 for r in found))


def at_positions(ordered: Ranges, positions: Iterable[int]) -> dict:
    """Key tuples at zero-based ``positions``. Only as many rows as there are positions reach the driver."""
    wanted = sorted(set(positions))
    if not wanted:
        return {}
    targets, start = [], 0
    for number, n in ordered.sizes:
        targets += [(p, number, p - start) for p in wanted if start <= p < start + n]
        start += n
    if len(targets) < len(wanted):
        raise ValueError("position outside the data")

    inside = Window.partitionBy("_range").orderBy(*ordered.keys).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.lit(False)
    for _, number, offset in targets:
        hit = hit | ((F.col("_range") == number) & (F.col("_upto") > offset) & (F.col("_upto") - F.col("_copies") <= offset))
    found = (
        ordered.table.filter(F.col("_range").isin([number for _, number, _ in targets]))
        .withColumn("_upto", F.sum("_copies").over(inside))
        .filter(hit)
        .collect()
    )
    result = {}
    for position, number, offset in targets:
        for row in found:
            if row["_range"] == number and row["_upto"] - row["_copies"] <= offset < row["_upto"]:
                result[position] = tuple(row[k] for k in ordered.keys)
    return result


def value_ranges(df: DataFrame, column: str) -> Ranges:
    """Ranges of a numeric column without nulls; copies of a hot value collapse before they are put into ranges."""
    return ranges(df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")), ["v"], weight="n")


def quantiles(ordered: Ranges, probabilities: Sequence[float]) -> list:
    """Linearly interpolated quantiles of ``value_ranges``; nulls for no rows."""
    rows = ordered.rows
    if rows == 0:
        return [None] * len(probabilities)
    places = [p * (rows - 1) for p in probabilities]
    at = at_positions(ordered, {int(x) for x in places} | {min(int(x) + 1, rows - 1) for x in places})
    result = []
    for place in places:
        low, high = int(place), min(int(place) + 1, rows - 1)
        result.append(at[low][0] if place == low else (high - place) * at[low][0] + (place - low) * at[high][0])
    return result


def rank_first_edges(df: DataFrame, keys: Sequence[str], bins: int) -> list:
    """Last key tuple of each bin but the last, for equal-width bins on the ranks 1..n.

    The first key is the ranked value; the others make ties unique, so equal values are ranked in the
    order of the remaining keys.
    """
    ordered = ranges(df, keys)
    if ordered.rows == 0:
        return []
    cuts = [s * (ordered.rows - 1) // bins for s in range(1, bins)]
    at = at_positions(ordered, cuts)
    return [at[c] for c in cuts]


def after(df: DataFrame, keys: Sequence[str], edge: Sequence) -> Column:
    """True for rows of ``df`` that come after ``edge`` in the order by ``keys``."""
    limit = [F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, edge)]
    return F.struct(*[F.col(k) for k in keys]) > F.struct(*limit)
