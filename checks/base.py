"""One registered query: its columns, its DataFrame and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import configure, release_shuffles

_SPARK_TYPES = {"s": "string", "l": "bigint", "i": "int", "d": "date", "t": "timestamp", "b": "boolean"}
_SQL_TYPES = {"s": "VARCHAR", "l": "BIGINT", "i": "INTEGER", "d": "DATE", "t": "TIMESTAMP", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Check:
    """``columns`` is ``name:kind`` per output column: s, l, i, d, t, b, or f and a number of decimals.

    A thousandth of the last digit is added before rounding, so that noise cannot turn an exact half down on
    one side and up on the other.
    """

    name: str
    columns: str
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    with_: tuple[str, ...] = ()

    def _columns(self) -> list[tuple[str, str]]:
        return [tuple(c.rsplit(":", 1)) for c in self.columns.split()]

    def _cast(self, name: str, kind: str) -> Column:
        if kind[0] == "f":
            digits = int(kind[1:])
            return F.round(F.col(name).cast("double") + F.lit(float(f"1e-{digits + 3}")), digits).alias(name)
        return F.col(name).cast(_SPARK_TYPES[kind]).alias(name)

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.query(release_shuffles(configure(spark)), folder)
        return df.select(*[self._cast(name, kind) for name, kind in self._columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        parts = []
        for name, kind in self._columns():
            if kind[0] == "f":
                digits = int(kind[1:])
                parts.append(f'round(CAST("{name}" AS DOUBLE) + 1e-{digits + 3}, {digits}) AS "{name}"')
            else:
                parts.append(f'CAST("{name}" AS {_SQL_TYPES[kind]}) AS "{name}"')
        body = f"SELECT {', '.join(parts)} FROM ({self.sql}) AS result"
        return f"WITH {', '.join(self.with_)} {body}" if self.with_ else body
