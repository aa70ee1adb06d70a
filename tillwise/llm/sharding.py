"""Minimax contiguous sharding of documents by bytes, with equal texts kept together.

The atomic groups are equal texts, ordered by the SHA-256 of the text. The
smallest capacity with which ``shards`` contiguous runs of groups hold
everything is found by binary search; a capacity is checked by filling shards
greedily. The cuts are then put, within what that capacity leaves open, where the
shards come nearest to equal parts.

The search needs running totals of all groups, but never has them: it works on
cells (hexadecimal prefixes of the order), first 65,536 of them. Treating cells
as uncuttable gives a feasible capacity, treating them as fluid gives a lower
bound, and both together say in which cells the cuts of the true optimum can
lie. Only those cells are asked for again one or two digits finer, until every
cut is at the edge of a group. What reaches the driver is one row per cell, so
its size depends on the number of shards and not on the table.

A group of at least the mean of what is left (a text with a third of all rows,
say) can't be balanced by anything; such groups leave the order, get shards of
their own first, and the search covers the rest.

Defined cases: a NULL text counts as empty, of 16 bytes. Rows with NULL or
repeated identifiers are rows like any other, spread by their place in the table. With fewer groups than shards some
shards stay empty. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from math import isqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.runtime import stored

# Bytes that each document takes besides its text.
ROW_BYTES = 16

_FIRST_DIGITS = 4
_DIGITS = 64
# Finer cells are asked for by two digits at once as long as this many rows come back at most.
_CELLS = 1 << 17


class Cell(NamedTuple):
    prefix: str
    size: int
    groups: int


class Cells:
    """Cells in order, with the greedy filling over them."""

    def __init__(self, cells: list[Cell]):
        self.cells = cells
        self.edges = [0, *accumulate(cell.size for cell in cells)]

    @property
    def total(self) -> int:
        return self.edges[-1]

    def fill(self, capacity: int, shards: int, fluid: bool) -> tuple[list[int], bool]:
        """Where greedy filling cuts, and whether everything fits.

        ``fluid``: a cell of several groups can be cut anywhere.
        """
        cuts, start = [], 0
        for _ in range(shards - 1):
            reach = start + capacity
            if reach >= self.total:
                start = self.total
            else:
                at = bisect_right(self.edges, reach) - 1
                start = reach if fluid and self.cells[at].groups > 1 else max(start, self.edges[at])
            cuts.append(start)
        return cuts, self.total - start <= capacity

    def smallest(self, shards: int, fluid: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, fluid)[1]:
                high = middle
            else:
                low = middle + 1
        return low

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Cuts of a feasible capacity that share what greedy filling would leave to the last shard.

        Filling from the end gives the first place of each cut from which the rest still
        fits. Behind that, each cut goes to the edge nearest to an equal part of what is left.
        """
        first, place = [], self.total
        for _ in range(shards - 1):
            place = self.edges[bisect_left(self.edges, place - capacity)] if place > capacity else 0
            first.append(place)
        cuts, start = [], 0
        for number, least in enumerate(reversed(first)):
            wanted = start + (self.total - start) // (shards - number)
            at = bisect_right(self.edges, wanted) - 1
            near = [edge for edge in self.edges[at : at + 2] if max(least, start) <= edge <= start + capacity]
            reach = self.edges[bisect_right(self.edges, start + capacity) - 1]
            start = min(near, key=lambda edge: abs(edge - wanted)) if near else min(max(least, start), reach)
            cuts.append(start)
        return cuts

    def unsettled(self, shards: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Cuts, and the runs of cells (first, last) in which cuts of the optimum are not settled yet."""
        low, high = self.smallest(shards, True), self.smallest(shards, False)
        first, last = self.fill(low, shards, False)[0], self.fill(high, shards, True)[0]
        runs: list[tuple[int, int]] = []
        for a, b in zip(first, last):
            if a < b:
                begin, end = bisect_right(self.edges, a) - 1, bisect_right(self.edges, b - 1) - 1
                if all(self.cells[i].groups == 1 for i in range(begin, end + 1)):
                    continue
                if runs and begin <= runs[-1][1] + 1:
                    runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
                else:
                    runs.append((begin, end))
        return self.fill(high, shards, False)[0], runs


def _cells(groups: DataFrame, digits: int) -> list[Cell]:
    found = groups.groupBy(F.substring("sha", 1, digits).alias("prefix")).agg(
        F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("groups")
    )
    return sorted(Cell(*row) for row in found.collect())


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """First prefix of each shard but the first, and the smallest feasible capacity.

    ``groups``: ``sha, bytes`` with one row per group. Shards at the end that
    stay empty have no entry.
    """
    digits = _FIRST_DIGITS
    state = Cells(_cells(groups, digits))
    while True:
        _, runs = state.unsettled(shards)
        if not runs or digits == _DIGITS:
            break
        asked = sum(last - first + 1 for first, last in runs)
        digits = min(_DIGITS, digits + (2 if asked * 256 <= _CELLS else 1))
        inside = F.lit(False)
        for first, last in runs:
            # "g" comes after every hexadecimal digit
            inside |= (F.col("sha") >= state.cells[first].prefix) & (F.col("sha") < state.cells[last].prefix + "g")
        finer = _cells(groups.filter(inside), digits)
        kept, at = [], 0
        for first, last in runs:
            kept += state.cells[at:first]
            at = last + 1
        state = Cells(sorted([*kept, *state.cells[at:], *finer]))
    capacity = state.smallest(shards, False)
    cuts = state.balanced(capacity, shards)
    starts = [state.cells[bisect_right(state.edges, cut) - 1].prefix for cut in cuts if cut < state.total]
    return starts, capacity


def _own_shards(groups: DataFrame, shards: int) -> list[str]:
    """Groups of at least the mean of what is left, largest first."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    for sha, size in groups.select("sha", "bytes").orderBy(F.desc("bytes"), "sha").limit(shards - 1).collect():
        if size * (shards - len(alone)) < total:
            break
        alone.append(sha)
        total -= size
    return alone


def _shard(alone: list[str], starts: list[str]) -> Column:
    sha = F.col("sha")
    number = F.lit(len(alone))
    for start in starts:
        number = number + (sha >= start).cast("int")
    for place, group in enumerate(alone):
        number = F.when(sha == group, place).otherwise(number)
    return number.cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("sha"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "shard-rows",
    )
    groups = stored(
        rows.groupBy("sha").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-groups"
    )
    alone = _own_shards(groups, shards)
    rest = groups.filter(~F.col("sha").isin(alone)) if alone else groups
    starts, _ = minimax_cuts(rest, shards - len(alone))

    # Slots: blocks of a shard are numbered in parallel, then moved behind the blocks before them.
    # There are as many blocks in a mean shard as rows in a mean block.
    blocks = max(1, isqrt((groups.agg(F.sum("rows")).first()[0] or 0) // shards))
    placed = rows.withColumn("shard", _shard(alone, starts)).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "sha", "row_no"), F.lit(blocks)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "block")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "sha", "row_no")) - 1
    return (
        placed.withColumn("within", within)
        .join(offsets, ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("within")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
