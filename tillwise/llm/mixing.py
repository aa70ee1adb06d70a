"""Mixing sources to target weights by repeating documents.

Words are summed per source. The sources, in order of their names, get the
weights in turn and share all words by weight; no target goes beyond ``most``
times what its source has, and what is cut off goes to the others, by weight. The
rate of a source is its target over its words. Every document is emitted
floor(rate) times, and once more where a hash of its identifier, read as a number
from 0 to 1, is below the fraction of the rate.

One draw per document leaves a source of few or of very unequal documents far
from its target. ``DRAWS`` independent hashes are therefore summed per source at
the same time, and each source takes the one that brings it nearest. Every draw
is a Bernoulli draw of its own, and all of it depends on the rows alone.

Rows meet only in sums per source, which are combined before they are shuffled.
The level at which targets share what is left is found by rounds over the table
of sources, each bringing two numbers to the driver. The joins back to the rows
have a written table as their other side, so Spark broadcasts it where its size
allows and can split the many rows of one source where not.

Defined cases: a NULL or empty text has size 0 and takes nothing. NULL is a source
of its own, the last. Rows without identifier are told apart by their text, so
equal ones share their draw; so do repeated rows. A source without words has target
0. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.runtime import stored

WEIGHTS = (5, 2, 1)
MOST = 3
# Eight hexadecimal digits each, of two SHA-256 digests.
DRAWS = 16

_SPACE = r"\x20\x09-\x0D"
_BASE = 1 << 32


def word_count(text: Column) -> Column:
    """Words of a text, counted without an array of them."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{_SPACE}]+", "x")
    return F.length(F.regexp_replace(marks, f"[{_SPACE}]+", "")).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.coalesce(F.col(id_col).cast("long").cast("string"), F.sha2(text, 256)).alias("mark"),
    )


def _draw(number: int) -> Column:
    digits = F.substring(F.sha2(F.concat(F.lit(f"mix {number // 8}:"), F.col("mark")), 256), 1 + 8 * (number % 8), 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(_BASE))


def _weighted(rows: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``source, source_size, weight``: the sources numbered in order of their names, without a window over all of them."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = stored(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    place = F.pmod(F.col("offset") + F.col("inside"), F.lit(len(weights)))
    return parts.withColumn("inside", inside).join(offsets, "part").select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("weight")
    )


def _share(sources: DataFrame, most: int) -> tuple[int, int]:
    """What sources within their bound share, and the sum of their weights."""
    wide = "decimal(38,0)"
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    left, parts = int(total or 0), int(weights or 0)
    while parts:
        full = _full(left, parts, most)
        taken, free = sources.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0).cast(wide)), F.sum(F.when(~full, F.col("weight")).otherwise(0))
        ).first()
        before, (left, parts) = (left, parts), (int(total) - int(taken), int(free))
        if before == (left, parts):
            break
    return left, parts


def _full(left: int, parts: int, most: int) -> Column:
    """Whether a source's share of ``left`` by weight is above its bound."""
    wide = "decimal(38,0)"
    bound = F.col("source_size").cast("decimal(18,0)") * F.lit(most * parts).cast("decimal(18,0)")
    return bound.cast(wide) < (F.lit(left).cast("decimal(18,0)") * F.col("weight").cast("decimal(9,0)")).cast(wide)


def _rates(rows: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``source, source_size, weight, target, whole, chance, draw`` per source of the sized rows."""
    sources = stored(_weighted(rows, weights), "mix-weights")
    left, parts = _share(sources, most)
    shared = F.lit(float(left)) * F.col("weight") / F.lit(float(max(parts, 1)))
    target = F.when(_full(left, parts, most), (F.col("source_size") * most).cast("double")).otherwise(shared)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = (
        sources.withColumn("target", target)
        .withColumn("whole", F.floor(rate).cast("long"))
        .withColumn("chance", rate - F.floor(rate))
    )
    rates = stored(rates, "mix-rates")
    extra = [
        F.sum(F.when(_draw(k) < F.col("chance"), F.col("size")).otherwise(0)).alias(f"extra{k}") for k in range(DRAWS)
    ]
    sums = _beside(rows, rates).groupBy("source").agg(*extra).withColumnRenamed("source", "name")
    off = [
        F.struct(
            F.abs(F.col("whole") * F.col("source_size") + F.col(f"extra{k}") - F.col("target")).alias("off"),
            F.lit(k).alias("draw"),
        )
        for k in range(DRAWS)
    ]
    best = F.array_min(F.array(*off))["draw"]
    return stored(
        rates.join(sums, F.col("source").eqNullSafe(F.col("name"))).select(*rates.columns, best.alias("draw")), "mix-draws"
    )


def _beside(rows: DataFrame, rates: DataFrame) -> DataFrame:
    named = rates.withColumnRenamed("source", "name")
    return rows.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")


def _copies(draw: Column) -> Column:
    chosen = F.lit(None).cast("double")
    for k in reversed(range(DRAWS)):
        chosen = F.when(draw == k, _draw(k)).otherwise(chosen)
    return (F.col("whole") + (chosen < F.col("chance")).cast("long")).alias("copies")


def copies_per_document(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copies`` for every row of ``docs``."""
    rows = stored(_sized(docs, id_col, text_col, source_col), "mix-rows")
    found = _beside(rows, _rates(rows, weights, most)).withColumn("copies", _copies(F.col("draw")))
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The documents of the mix: every row of ``docs`` as often as it is taken, all columns as they are."""
    sized = _sized(docs, id_col, text_col, source_col)
    rates = _rates(stored(sized, "mix-rows"), weights, most)
    fields = [F.col(f"row.`{name}`").alias(name) for name in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.coalesce(F.col(id_col).cast("long").cast("string"), F.sha2(text, 256))
    whole_rows = docs.select(
        F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row"),
        F.col(source_col).cast("string").alias("source"), mark.alias("mark"),
    )
    taken = _beside(whole_rows, rates).withColumn("copies", _copies(F.col("draw")))
    return taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*fields)
