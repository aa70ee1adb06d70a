"""Shared folder, stored tables and code shipping for the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from tillwise.session import size_bytes

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()

# Bytes of an Arrow batch between Spark and Python, where nothing smaller is set.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, also where they don't share the driver's folders."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        archive = os.path.join(tempfile.mkdtemp(prefix="code-"), "tillwise.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(_PACKAGE):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Give Python batches of few bytes. Left alone, Spark closes a batch after 10,000 rows or 64 MB of them,
    and a task has each batch several times: as columns, as bytes on the way and in Python."""
    if size_bytes(spark.conf.get(_BATCH_BYTES)) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that setting is missing, a local session (tests, a laptop) gets a folder of
    its own, set as the checkpoint folder; on a cluster that is an error. What is
    written there stays until whoever owns the folder removes it: a task that runs
    again may need it as long as a DataFrame made of it is in use.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        found = context._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tillwise-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
