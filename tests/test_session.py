"""Session settings that bound what one task holds."""

from __future__ import annotations

import pytest

from tillwise import session
from tillwise.session import configure

SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.fixture
def bare(spark):
    """The session without the two settings."""
    before = {key: spark.conf.get(key, None) for key in (SIZE, FIRST)}
    for key in before:
        spark.conf.unset(key)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("given, found", [(None, "16m"), ("64MB", "16m"), ("1g", "16m"), ("8m", "8m"), ("10KB", "10KB"), ("16384", "16384")])
def test_tasks_get_few_bytes(bare, given, found):
    if given is not None:
        bare.conf.set(SIZE, given)
    assert configure(bare).conf.get(SIZE) in (found, f"{session.size_bytes(found)}b")


def test_shuffles_can_be_cut_finely(bare):
    assert configure(bare).conf.get(FIRST) == str(session.FIRST_PARTS)
    bare.conf.set(FIRST, "64")
    assert configure(bare).conf.get(FIRST) == "64"


def test_tasks_grow_in_number_not_in_size(bare):
    """100 MB of shuffled rows: more tasks than cores, and more than the two that the session asks for."""
    rows = configure(bare).range(0, 3_000_000, 1, 4).selectExpr("id AS key", "xxhash64(id) AS a", "xxhash64(id, 1) AS b", "xxhash64(id, 2) AS c")
    assert rows.groupBy("key").max("a", "b", "c").rdd.getNumPartitions() > 2
