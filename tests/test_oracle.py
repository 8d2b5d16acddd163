"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
import compare
from conftest import SMALL
from pawledger.checks import oracle, queries as registry


@pytest.fixture(scope="module")
def con():
    connection = compare.connect(SMALL)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(registry.registered()) == set(oracle.statements())


@pytest.mark.parametrize("name", sorted(registry.registered()))
def test_query_equals_sql(spark, con, name):
    columns, cells = compare.spark_table(registry.registered()[name](spark, SMALL))
    sql_columns, sql_cells = compare.sql_table(con, oracle.statements()[name])
    assert columns == sql_columns
    assert cells == sql_cells
    assert cells, "a query without rows checks nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_other_time_zone(spark, con):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("life_stage_metrics", "day_night_split", "calendar_labels", "weekly_kpi"):
            got = compare.spark_table(registry.registered()[name](spark, SMALL))
            assert got == compare.sql_table(con, oracle.statements()[name]), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
