"""Every registered query against the same question in DuckDB SQL."""

import os

import pytest

import __spark_entry__ as entry_points
from plumbline.registry import ORACLE_SQL, QUERIES
from tests.parity import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    assert differences(df, duck, entry_points.oracle_sql()[name]) == []


def test_registries_agree():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE_SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
