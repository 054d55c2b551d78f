"""Run the registered queries and their SQL on the same tables and compare the values.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _sorted(rows) -> list:
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=repr)


def difference(df, connection, sql: str) -> str | None:
    """None when columns and values agree, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    expected = _sorted([tuple(r[names.index(n)] for n in order) for r in result.fetchall()])
    found = _sorted([tuple(r) for r in df.select(*[f"`{n}`" for n in order]).collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows, expected {len(expected)}"
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    return f"{len(wrong)} rows differ, first {order}: {wrong[0]}" if wrong else None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from checks.registry import CHECKS
    from checks.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(sys.argv[2:])
    spark, connection = local_session(), connect(folder)
    failed = 0
    for check in CHECKS:
        if wanted and check.name not in wanted:
            continue
        start = time.time()
        try:
            df = check.run(spark, folder)
            sql = check.oracle()
            problem = difference(df, connection, sql) if sql else None
            state = problem or ("ok" if sql else f"rows only: {df.count()}")
        except Exception as error:  # reported and counted, the other queries still run
            state = problem = f"{type(error).__name__}: {str(error)[:400]}"
        failed += problem is not None
        print(f"{check.name:28s} {time.time() - start:6.2f}s  {state}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
