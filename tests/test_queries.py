"""Registered queries against their SQL on the smallest tables. Slow ones run in the full check only."""

import pytest

import compare
from marketloom.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# Thousands of small partition folders or many fits; run with `python tests/full_check.py`.
SLOW = ("lake_", "partition_check", "stream_bronze", "stream_incremental", "stream_quarantine")


@pytest.fixture(scope="session")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in sorted(ORACLES) if not n.startswith(SLOW)])
def test_equals_sql(spark, con, name):
    problem, _, _, _ = compare.compare(spark, con, FOLDER, QUERIES[name], ORACLES[name])
    assert problem is None, problem
