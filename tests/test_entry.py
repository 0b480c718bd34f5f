"""The driver's contract."""

import os

import pytest

import __spark_entry__ as e


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 140


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["company", "node", "low", "high", "unknown", "level"]
    assert df.filter("abs(low + high + unknown - 1) > 1e-8").count() == 0 and df.count() > 0
