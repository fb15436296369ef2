"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
# the answering plan runs once, in test_answering.py
NAMES = [n for n in entry.queries() if n != "answer_questions"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, rows, _took, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert status in ("ok", "rows-only"), note
    assert rows > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
