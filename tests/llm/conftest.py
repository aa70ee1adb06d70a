from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names the operators use themselves.
CLASHING = SCHEMA + ", row string, f long, kept string, text_sha256 string, chunk long, length int, size string, score string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns of clashing names on request."""

    def build(pairs, clashing=False):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in pairs]
        if clashing:
            return spark.createDataFrame([(*row, "x", 1, "y", "z", 2, 3, "s", "t") for row in rows], CLASHING)
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_pairs():
    """NULLs, empty and very long texts, ties, repeated rows, and ordinary ones."""
    dice = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "42", "eta!"]

    def text(n):
        return " ".join(dice.choice(words) for _ in range(n))

    base = [text(dice.randint(1, 40)) for _ in range(60)]
    pairs = list(enumerate(base))
    pairs += [(100 + i, t.replace(" ", "  \t")) for i, t in enumerate(base[:10])]
    pairs += [(200 + i, t + " more") for i, t in enumerate(base[:10])]
    pairs += [(300, None), (301, ""), (302, " \n "), (303, text(30_000)), (304, "x" * 20_000), (None, base[0]), (None, None)]
    pairs += [(5, base[5]), (5, base[5]), (6, base[7])]
    return pairs


SKEW_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
}


@pytest.fixture
def skewed(spark):
    """Small partitions already count as skewed; gives a function for the rows and the final plan of a frame."""
    before = {key: spark.conf.get(key, None) for key in SKEW_SETTINGS}
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)

    def run(frame):
        rows = frame.collect()
        return rows, frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    yield run
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
