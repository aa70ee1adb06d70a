from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences
from tests.conftest import TESTDATA
from tillwise.llm import registry

DIRECTORY = f"{TESTDATA}/sf0.001"
WITH_SQL = {"op1_exact_dedup", "op5_warc", "op11_fill_in_middle", "op12_mixing"}
# Held against brute force, the library, or walked models by the other tests of this folder.
WITHOUT_SQL = {
    "op2_token_counts", "op3_sharding", "op4_secret_scan", "op6_toxicity", "op7_lm_scoring", "op8_simhash",
    "op9_decontaminate", "op10_bpe", "op13_periodic_runs",
}


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", sorted(WITH_SQL))
def test_query_matches_check(spark, duck, name):
    assert differences(entry.queries()[name](spark, DIRECTORY), duck, entry.oracle_sql()[name]) == []


def test_which_queries_have_sql():
    assert set(registry.QUERIES) == WITH_SQL | WITHOUT_SQL
    assert set(registry.ORACLE_SQL) == WITH_SQL
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert "pipeline" not in entry.oracle_sql()
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
