"""Every registered query against its SQL on the smallest tables; queries without SQL must return rows."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    status, note, _ = check.compare(spark, con, name, SF)
    assert status in ("ok", "near", "rows"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
