"""Connected components of an edge list, by alternating large and small stars.

Large star: every larger neighbour of a node is linked to the smallest node the
node sees. Small star: the node and its smaller neighbours are linked to the
smallest of them. Both keep the components; in the end every node is linked to
the smallest node of its component. Edges stay in DataFrames throughout, each
round is written to the shared folder, and the smallest neighbours are shuffled
apart from the edges, so that a node with very many neighbours can be split in
the joins with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.runtime import stored
from tillwise.plans.sales import totals_apart


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = totals_apart(both, ["u"], F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have ``u > v``, as :func:`_large_star` leaves them."""
    least = totals_apart(edges, ["u"], F.min("v").alias("least"))
    moved = edges.join(least, "u").filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return least.select("u", F.col("least").alias("v")).union(moved).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``u, v``: every node with a smaller node in its component, and the smallest node there.

    ``edges``: two LONG columns ``u, v``, not NULL, in any direction and number.
    """
    edges = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges
