"""Every registered query against its check query on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences
from checks.registry import REGISTRY
from tests.conftest import TESTDATA
from tillwise.operators import OPERATORS, dashboard

DIRECTORY = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_check(spark, duck, name):
    frame = entry.queries()[name](spark, DIRECTORY)
    assert differences(frame, duck, entry.oracle_sql()[name]) == []


def test_every_report_is_registered():
    assert set(OPERATORS) <= set(REGISTRY)
    assert set(dashboard.__all__) - {"with_trend_class"} <= set(REGISTRY)
    assert set(REGISTRY) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
