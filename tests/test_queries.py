"""Every registered query against its SQL on the smallest benchmark tables."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from checks.base import Check
from checks.compare import connect, difference
from checks.registry import CHECKS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("check", CHECKS, ids=lambda c: c.name)
def test_query_equals_sql(spark, oracle, check: Check):
    df = check.run(spark, FOLDER)
    sql = check.oracle()
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, oracle, sql) is None


def test_entry_and_registry(spark):
    assert len({c.name for c in CHECKS}) == len(CHECKS)
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns[:3] == ["Date", "Platform", "Orders"]
