from __future__ import annotations

import pyarrow as pa
import pytest

from tillwise.llm.exact_dedup import copy_groups
from tillwise.llm.fill_in_middle import transformation_digests
from tillwise.llm.runtime import BATCH_BYTES, bound_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def batch_sizes(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64())})

    rows = spark.range(0, 600, 1, 1).selectExpr("repeat('x', 40000) AS text")
    return [row["size"] for row in rows.mapInArrow(run, "size long").collect()]


def test_batches_have_few_bytes(unbounded):
    assert max(batch_sizes(unbounded)) > 4 * BATCH_BYTES
    bound_batches(unbounded)
    sizes = batch_sizes(unbounded)
    assert max(sizes) < 1.1 * BATCH_BYTES and sum(sizes) > 20_000_000


def test_smaller_settings_stay(unbounded):
    unbounded.conf.set(KEY, "1m")
    bound_batches(unbounded)
    assert unbounded.conf.get(KEY) in ("1m", f"{1 << 20}b")


@pytest.mark.parametrize("operator", [copy_groups, transformation_digests])
def test_operators_on_long_texts_bound_their_batches(unbounded, docs_of, operator):
    docs = docs_of([(1, "a b"), (2, None)])
    assert operator(docs).count() == 2
    assert max(batch_sizes(unbounded)) < 1.1 * BATCH_BYTES
