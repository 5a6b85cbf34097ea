"""Every registered query against its SQL on the smallest tables; the fits are run by the driver and by bench.py."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(query.__doc__ for query in entry.queries().values())


def test_flagship(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_queries_agree_with_their_sql(spark):
    from compare import differences

    assert differences(spark, FOLDER, sorted(entry.oracle_sql())) == {}
