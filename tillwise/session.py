"""Session settings the operators rely on."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# Runtime SQL settings. The first is needed for right results, the others keep
# the plans good on skewed and on very large inputs.
RUNTIME_SETTINGS = {
    # Stored datetimes carry no zone; one fixed zone keeps month and day cuts stable.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join partitions even where that costs a further shuffle: the
    # cost is only paid when a hot key is really there.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Written timestamps carry statistics, so date ranges can skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

# Shuffled bytes that adaptive execution puts into one task at most, where nothing smaller is
# set. Sorts and aggregations hold some twenty times as much. Left alone, Spark makes no more
# tasks than cores until each has 64 MB, so that a task's memory grows with the input.
TASK_BYTES = "16m"
_TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# Shuffles start with so many parts at least; adaptive execution merges the small ones again.
FIRST_PARTS = 200
_FIRST_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_PARTS = "spark.sql.shuffle.partitions"


def size_bytes(size: str) -> int:
    """A size as Spark's settings give it (``64MB``, ``16m``, ``1024``)."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if size_bytes(spark.conf.get(_TASK_BYTES)) > size_bytes(TASK_BYTES):
        spark.conf.set(_TASK_BYTES, TASK_BYTES)
    if spark.conf.get(_FIRST_PARTS, None) is None and int(spark.conf.get(_PARTS)) < FIRST_PARTS:
        spark.conf.set(_FIRST_PARTS, str(FIRST_PARTS))
    return spark


def build_session(app_name: str = "tillwise", master: str | None = None, **extra: str) -> SparkSession:
    """Start a session. Cluster-level settings come from the submitting side."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
