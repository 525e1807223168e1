"""Every registered query against its SQL on the given tables, where they exist."""

import os

import pytest

import __spark_entry__ as entry
from workload import check

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


QUERIES = {name: query for q in entry.REGISTRIES for name, query in q.queries.items()}
ORACLES = {name: sql for q in entry.REGISTRIES for name, sql in q.oracles.items()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    good, message = check.compare(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert good, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
