"""Ranks and cuts of rows in any order, without a task that has all of them.

The rows are cut into ranges at splitters: ``SPLITTERS`` rows of the table itself,
those with the smallest hashes, which makes them a random sample. Where rows crowd
(keys with a common prefix, say) splitters crowd too, so the ranges stay about
equal whatever the values look like. Each range is counted, and no task sorts more
than a range. Nothing is collected: the splitters are a scalar subquery of bounded
size, and every part of the plan computes them alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITTERS = 512
# Every so many splitters one is compared first.
_STEP = 32


def ranged(df: DataFrame, columns: Sequence[str], name: str = "range") -> DataFrame:
    """Add ``name``: how many splitters come before a row in ascending order of ``columns`` (NULL first).

    Rows that agree in all ``columns`` share a range.
    """
    # A structure compares field by field and puts NULL first, as an ascending sort does.
    row = F.struct(*columns)
    sample = df.select(row.alias("row")).orderBy(F.xxhash64("row"), "row").limit(SPLITTERS)
    fine = F.array_sort(F.collect_set("row"))
    coarse = F.filter(fine, lambda x, at: at % _STEP == 0)
    splitters = sample.agg(F.struct(fine.alias("fine"), coarse.alias("coarse")))
    block = F.greatest(F.size(F.filter("splitters.coarse", lambda x: x < row)) - 1, F.lit(0))
    inside = F.slice("splitters.fine", F.col("block") * _STEP + 1, F.lit(_STEP))
    place = F.col("block") * _STEP + F.size(F.filter(inside, lambda x: x < row))
    # (declared non-NULL, or every join on it would work the place out twice to filter NULLs)
    return df.withColumn("splitters", splitters.scalar()).withColumn("block", block).withColumn(name, F.coalesce(place, F.lit(0))).drop("splitters", "block")


def _counted(rows: DataFrame) -> DataFrame:
    """``range, earlier``: rows of all ranges before each one. At most ``SPLITTERS + 1`` rows."""
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))


def _placed(rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the 0-based place of each row in ascending order of ``columns``."""
    spread = ranged(rows, columns)
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*columns)) - 1
    return (
        spread.withColumn("inside", inside)
        .join(F.broadcast(_counted(spread)), "range")
        .withColumn(name, F.col("earlier") + F.col("inside"))
        .drop("range", "inside", "earlier")
    )


def label_places(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column, name``: the 0-based place of each distinct value in ascending order."""
    return _placed(df.select(column).distinct(), [column], name).withColumn(name, F.col(name).cast("int"))


def sort_columns(order: Sequence[Column | str]) -> tuple[list[Column], dict[str, Column]]:
    """An order as sort expressions, and as columns whose ascending order it is.

    ``"name"`` and expressions sort ascending, NULL first; ``"-name"`` (a number)
    sorts descending, NULL last.
    """
    sorts, columns = [], {}
    for number, part in enumerate(order):
        name = f"order_{number}"
        if isinstance(part, str) and part.startswith("-"):
            value = F.col(part[1:])
            sorts.append(value.desc())
            columns |= {f"{name}_none": value.isNull(), name: -value}
        else:
            value = F.col(part) if isinstance(part, str) else part
            sorts.append(value.asc())
            columns[name] = value
    return sorts, columns


def first_rows(df: DataFrame, limit: int, columns: dict[str, Column]) -> DataFrame:
    """The first ``limit`` rows in ascending order of ``columns``, which have no ties."""
    placed = _placed(df.withColumns(columns), list(columns), "place")
    return placed.filter(F.col("place") < limit).drop("place", *columns)
