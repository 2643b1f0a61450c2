"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import check
from dealwright.plans.all_queries import CHECKS, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, _, _ = check.compare(spark, con, SF, name, QUERIES[name], CHECKS.get(name))
    assert verdict.startswith(("ok", "rows")), verdict


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
