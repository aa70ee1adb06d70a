"""The ``Store``: one place the operators get their tables from."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.dates import MONTH_COLUMN, month_number
from tillwise.session import configure
from tillwise.sources.schemas import ALIASES, KEYS, PHYSICAL, REQUIRED, SCHEMAS

Loader = Callable[[str], DataFrame | None]

# Rows that one connection of a shop database reads, and how many connections a table may take.
ROWS_PER_READ = 1_000_000
MOST_READS = 512

# Tables that are written by month, and by which column: the part of a path that a range of days can prune.
MONTHLY = {"orders": "date_created"}
MONTH = "{column}_month"
# What the rows of a written table are sorted by, so that row groups can be skipped and joins find their rows together.
CLUSTERED = {
    "orders": "id", "order_items": "order_id", "order_addresses": "order_id",
    "subscriptions": "customer_id", "customers": "id", "licenses": "id", "license_activations": "license_id",
}


def key_ranges(
    name: str, rows: int, low: int | None, high: int | None, rows_per_read: int = ROWS_PER_READ, most_reads: int = MOST_READS
) -> dict[str, Any]:
    """JDBC partitioning options for a table of ``rows`` rows whose key goes from ``low`` to ``high``."""
    if rows <= rows_per_read:
        return {}
    if low is None or high is None or int(high) <= int(low):
        raise ValueError(f"table {name} has {rows} rows and no range of {KEYS[name]} to split them by: give a split for it")
    reads = min(most_reads, -(-rows // rows_per_read), int(high) - int(low) + 1)
    return {"partitionColumn": KEYS[name], "lowerBound": int(low), "upperBound": int(high) + 1, "numPartitions": reads}


class Store:
    """Typed, lazy access to the tables of one shop.

    A store is built from a loader: a function from table name to DataFrame, or
    to None where the source has no such table. Use one of the ``from_*``
    constructors. Tables are loaded on first use; loading reads metadata only.
    """

    def __init__(self, spark: SparkSession, loader: Loader):
        self.spark = configure(spark)
        self._loader = loader
        self._loaded: dict[str, DataFrame | None] = {}

    # ---- constructors ---------------------------------------------------

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> Store:
        unknown = set(frames) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        return cls(spark, lambda name: frames.get(name))

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, prefix: str = "") -> Store:
        """Parquet files or directories ``{root}/{prefix}{table}[.parquet]``.

        Orders in folders by month (see :meth:`write_parquet`) are pruned by every range
        of days: the declared column says which column its folders are named by.
        """

        def load(name: str) -> DataFrame | None:
            for path in (f"{root}/{prefix}{name}", f"{root}/{prefix}{name}.parquet"):
                try:
                    return spark.read.parquet(path)
                except AnalysisException as exc:
                    if exc.getCondition() != "PATH_NOT_FOUND":
                        raise
            return None

        return cls(spark, load)

    @classmethod
    def from_catalog(cls, spark: SparkSession, prefix: str = "wp_", database: str | None = None) -> Store:
        """Catalog tables or temporary views named ``{prefix}{physical name}``."""

        def load(name: str) -> DataFrame | None:
            table = f"{prefix}{PHYSICAL[name]}"
            if database is not None:
                table = f"{database}.{table}"
            return spark.table(table) if spark.catalog.tableExists(table) else None

        return cls(spark, load)

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        prefix: str = "wp_",
        properties: Mapping[str, str] | None = None,
        split: Mapping[str, Mapping[str, Any]] | None = None,
        present: set[str] | None = None,
        rows_per_read: int = ROWS_PER_READ,
        most_reads: int = MOST_READS,
    ) -> Store:
        """A live shop database, read in ranges of each table's key.

        A table is asked once for its rows and the bounds of its key (``KEYS``), and
        then read in as many ranges as give ``rows_per_read`` rows each, at most
        ``most_reads``. ``split`` gives other JDBC partitioning options for a table
        (``partitionColumn``, ``lowerBound``, ``upperBound``, ``numPartitions``), which
        are taken as they are. A table of more rows than one read should have, whose
        key has no bounds to split by, is refused. ``present`` names the tables that
        exist; by default all are expected.
        """

        def source(table: str):
            return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**dict(properties or {}))

        def load(name: str) -> DataFrame | None:
            if present is not None and name not in present:
                return None
            table = f"{prefix}{PHYSICAL[name]}"
            ranges = (split or {}).get(name)
            if ranges is None:
                key = KEYS[name]
                asked = f"(SELECT count(*) AS n, min({key}) AS low, max({key}) AS high FROM {table}) bounds"
                n, low, high = source(asked).load().first()
                ranges = key_ranges(name, int(n), low, high, rows_per_read, most_reads)
            return source(table).options(**dict(ranges)).load()

        return cls(spark, load)

    # ---- access ---------------------------------------------------------

    def _source(self, name: str) -> DataFrame | None:
        if name not in SCHEMAS:
            raise KeyError(f"no such store table: {name}")
        if name not in self._loaded:
            frame = self._loader(name)
            self._loaded[name] = None if frame is None else _declared(name, frame)
        return self._loaded[name]

    def has(self, name: str) -> bool:
        return self._source(name) is not None

    def table(self, name: str) -> DataFrame:
        """The table in its declared schema; a missing optional table is empty."""
        frame = self._source(name)
        if frame is not None:
            return frame
        if name in REQUIRED:
            raise LookupError(f"required table is missing: {name}")
        return self.spark.createDataFrame([], SCHEMAS[name])

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    def with_tables(self, **frames: DataFrame) -> Store:
        """A store with some tables replaced."""
        return Store(self.spark, lambda name: frames[name] if name in frames else self._source(name))

    def write_parquet(self, root: str, prefix: str = "", tables: tuple[str, ...] | None = None) -> None:
        """Write the tables as ``{root}/{prefix}{table}``, for ``from_parquet`` to read.

        Orders go into a folder per month, so that a report with a range lists and
        reads the folders of its months only. Rows are sorted by the key they are
        joined on (``CLUSTERED``), so that statistics of row groups tell keys apart.
        """
        for name in tables or tuple(t for t in SCHEMAS if self.has(t)):
            frame, folders = self.table(name), []
            if name in MONTHLY:
                folders = [MONTH.format(column=MONTHLY[name])]
                frame = frame.withColumn(folders[0], month_number(F.col(MONTHLY[name])))
            if name in CLUSTERED:
                # A month of any size is written by as many tasks as there are ranges of keys in it.
                frame = frame.repartitionByRange(*folders, CLUSTERED[name]).sortWithinPartitions(*folders, CLUSTERED[name])
            frame.write.mode("errorifexists").partitionBy(*folders).parquet(f"{root}/{prefix}{name}")

    def write_catalog(
        self, prefix: str = "wp_", database: str | None = None, buckets: int = 64, tables: tuple[str, ...] | None = None
    ) -> None:
        """Write the tables as catalog tables for ``from_catalog``, with the same buckets for all that are joined by order.

        Items, addresses and orders then meet without a shuffle. ``buckets`` should give
        a bucket of the largest table that a task can sort.
        """
        for name in tables or tuple(t for t in SCHEMAS if self.has(t)):
            writer = self.table(name).write.format("parquet").mode("errorifexists")
            if name in CLUSTERED:
                writer = writer.bucketBy(buckets, CLUSTERED[name]).sortBy(CLUSTERED[name])
            table = f"{prefix}{PHYSICAL[name]}"
            writer.saveAsTable(table if database is None else f"{database}.{table}")

    def required_tables(self) -> DataFrame:
        """``(table_name, present)`` for the tables every installation must have."""
        rows = [(name, self.has(name)) for name in REQUIRED]
        return self.spark.createDataFrame(rows, "table_name string, present boolean")


# Columns a source may leave out; they read as NULL. A report that reads any other missing column fails.
OPTIONAL_COLUMNS = {("customers", "name"), ("orders", "gateway"), ("orders", "ip")}


def _declared(name: str, frame: DataFrame) -> DataFrame:
    """Select the declared columns; cast only where the stored type differs.

    Columns that already fit stay bare references, so filters on them still
    reach the file scan.
    """
    stored = {field.name.lower(): field for field in frame.schema}
    columns = []
    for field in SCHEMAS[name]:
        names = (field.name, *ALIASES.get((name, field.name), ()))
        source = next((stored[n] for n in names if n in stored), None)
        if source is None:
            optional = (name, field.name) in OPTIONAL_COLUMNS
            absent = F.lit(None) if optional else F.raise_error(F.lit(f"table {name} has no column {field.name}"))
            column = absent.cast(field.dataType)
        elif source.dataType == field.dataType:
            column = F.col(f"`{source.name}`")
        else:
            column = F.col(f"`{source.name}`").cast(field.dataType)
        month = stored.get(MONTH.format(column=field.name))
        pruned = {} if month is None else {"metadata": {MONTH_COLUMN: month.name}}
        columns.append(column.alias(field.name, **pruned))
    return frame.select(*columns)
