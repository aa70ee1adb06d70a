"""Running totals and ranks that never put an unbounded group into one task.

A window over one customer, or over a whole table, is sorted and walked by a
single task. That is fine for most customers and hopeless for one that owns a
third of all orders. The functions here break such a group into blocks along
its order, total the blocks, and add the total of all earlier blocks to the
running value inside each block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values per block on each level of a value ranking.
_BLOCK = 1 << 16

# Blocks of time of a running total, in microseconds: four hours, a tenth of a second. Fifty years have
# 110,000 of the first, one of those has 144,000 of the second, and those have 100,000 moments.
WIDTHS = (4 * 3_600_000_000, 100_000)

_COMBINE = {"sum": F.sum, "max": F.max}


def all_read(*columns: str) -> Column:
    """True for every row, but it reads ``columns``.

    Two uses of a sub-plan share its shuffles if they read the same columns of it;
    otherwise each use makes its own, with its columns only.
    """
    return F.pmod(F.hash(*columns), F.lit(2)) >= 0


def _merge(kind: str, earlier: Column, own: Column) -> Column:
    """Combine two partial values; NULL means nothing there yet."""
    if kind == "sum":
        return F.coalesce(earlier + own, earlier, own)
    return F.greatest(earlier, own)


def _aggregates(measures: Mapping[str, str]) -> list[Column]:
    return [_COMBINE[kind](name).alias(name) for name, kind in measures.items()]


def prefix_before(
    cells: DataFrame, within: Sequence[str], levels: Sequence[str], measures: Mapping[str, str]
) -> DataFrame:
    """Total of each measure over the cells strictly before each cell.

    ``cells`` has one row per ``within + levels``. ``levels`` go from coarse to
    fine and order the cells; each must have few values under one value of the
    level before it, because that many rows meet in one task.
    """
    own = Window.partitionBy(*within, *levels[:-1]).orderBy(levels[-1])
    own = own.rowsBetween(Window.unboundedPreceding, -1)
    running = {f"{m}_before": _COMBINE[kind](m).over(own) for m, kind in measures.items()}
    if len(levels) == 1:
        return cells.withColumns(running)

    above = [*within, *levels[:-1]]
    blocks = prefix_before(
        cells.groupBy(*above).agg(*_aggregates(measures)), within, levels[:-1], measures
    )
    blocks = blocks.select(*above, *(F.col(f"{m}_before").alias(f"{m}_earlier") for m in measures))
    joined = cells.join(blocks, above).withColumns(running)
    return joined.withColumns(
        {
            f"{m}_before": _merge(kind, F.col(f"{m}_earlier"), F.col(f"{m}_before"))
            for m, kind in measures.items()
        }
    ).drop(*(f"{m}_earlier" for m in measures))


def value_levels(value: Column, descending: bool = False) -> dict[str, Column]:
    """Columns ``super``, ``block``, ``fine`` that order money amounts, coarse to fine.

    They are declared non-NULL (callers have no NULL amounts), which keeps the
    optimizer from adding a different NULL filter to every use of the same
    sub-plan; the exchanges below can then be reused.
    """
    cents = (value * 100).cast("long")
    fine = F.coalesce(-cents if descending else cents, F.lit(0).cast("long"))
    block = F.coalesce(F.floor(fine / _BLOCK), F.lit(0).cast("long"))
    return {"super": F.coalesce(F.floor(block / _BLOCK), F.lit(0).cast("long")), "block": block, "fine": fine}


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """``value, n``: distinct values (not NULL) and how often they occur."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def value_ranks(counts: DataFrame, value: str, descending: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """Exact ranks of a money column, one row per distinct value of ``counts``, within each of the columns ``within``.

    Returns ``within``, ``value``, ``n`` (rows with this value) and ``n_before`` (rows that
    sort before it), so row ``k`` of the sorted column has the value with
    ``n_before <= k < n_before + n``. Values are whole cents, hence at most
    65,536 of them share a block and at most 65,536 blocks share a super-block;
    the single top task sees one row per super-block (about 43 million units of
    money each).
    """
    cells = counts.withColumns(value_levels(F.col(value), descending))
    ranked = prefix_before(cells, within, ["super", "block", "fine"], {"n": "sum"})
    return ranked.select(*within, value, "n", F.coalesce("n_before", F.lit(0)).alias("n_before"))


def running_before(
    rows: DataFrame, key: str, instant: str, measures: Mapping[str, str], micro: int = 1, widths: Sequence[int] = WIDTHS
) -> DataFrame:
    """Add ``{measure}_before``: the measure over the key's strictly earlier rows.

    ``instant`` is a LONG that orders the rows of a key, ``micro`` of them to a
    microsecond; rows at the same instant do not see each other. The rows of a key
    are cut into blocks of time that get finer by fixed ``widths`` (in
    microseconds). A row adds what its own finest block has before it to the totals
    of the blocks before that one, level by level. No window ever has more than a
    few hundred thousand blocks or moments, however many rows a key has in a year or
    within an hour. The caller has collapsed copies. Rows without a key have nothing
    before them; each is a block of its own.
    """
    none = F.col(key).isNull()
    levels = [f"block_{number}" for number in range(len(widths))]
    own_block = F.xxhash64(*rows.columns)
    # Declared non-NULL, as in value_levels: a NULL filter would be added to one use of the placement only.
    blocks = {
        name: F.coalesce(F.when(none, own_block).otherwise(F.floor(F.col(instant) / F.lit(width * micro))), F.lit(0))
        for name, width in zip(levels, widths)
    }
    owner = ["key_none", "key_value"]
    placed = rows.withColumns({"key_none": none, "key_value": F.coalesce(F.col(key).cast("long"), F.lit(0)), **blocks})
    # Placed once by their finest block: its totals and its running values need no further shuffle of the rows.
    placed = placed.repartition(*owner, *levels)
    owned = F.count(F.when(all_read(*rows.columns), F.col(key))).alias("owned")
    totals = placed.groupBy(*owner, *levels).agg(*_aggregates(measures), owned).filter("owned > 0").drop("owned")
    before = prefix_before(totals, owner, levels, measures)
    before = before.select(*owner, *levels, *(F.col(f"{m}_before").alias(f"{m}_earlier") for m in measures))
    own = Window.partitionBy(*owner, *levels).orderBy(instant).rangeBetween(Window.unboundedPreceding, -1)
    return placed.join(before, [*owner, *levels], "left").withColumns(
        {
            f"{m}_before": _merge(kind, F.col(f"{m}_earlier"), _COMBINE[kind](m).over(own))
            for m, kind in measures.items()
        }
    )
