"""Near-duplicates by SimHash: exact tiled comparison of fingerprints.

A fingerprint has bit ``b`` set if more than half of the text's shingle hashes
have it. Equal fingerprints are merged first. What is compared are tiles of
distinct fingerprints: numpy exclusive-or and bit counts over the whole tile
pair, except where the population counts of rows and columns differ by more
than the radius, which is skipped.

Tiles are made so that the work stays in proportion to the table. Two
fingerprints within radius ``r`` agree in one of ``r + 1`` blocks of bits, so a
fingerprint goes to ``r + 1`` buckets, by as many bits of each block as give
buckets of one tile (beyond 2^16 tiles, by two blocks; one tile is one bucket).
So the tiles that meet are chosen by an index, which loses no link. A bucket that is larger
than a tile (near copies by the thousand, or a bit that all texts share) is cut
by population count and then at random, and its tile pairs are compared by
different tasks. A tile pair gives a spanning forest of its links and not the
links, so crowded groups give no more rows than they have members.

Defined cases: a NULL or empty text has fingerprint zero, which is linked like
any other. Rows with NULL identifiers take part; an identifier that is not NULL
goes before NULL as ``component_id``. If rows repeat the smallest identifier of a
group, one of them stays in :func:`keep_one_of_each`. An empty table gives an
empty result. Other columns may have any name.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.components import smallest_reachable
from tillwise.llm.runtime import ship, stored
from tillwise.plans.sales import totals_apart

SEED = 42

# Fingerprints in a tile, and in a bucket that is still compared in one piece.
TILE = 2048
_ONE_PIECE = 4 * TILE

# Rows of a tile that meet all columns at once; bounds the memory of a comparison.
_ROWS = 256
_HASHES = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text. ``bytes.lower`` and ``bytes.split`` know ASCII letters and white space only."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))
    count = max(1, len(words) - shingle + 1)
    spans = zip([0, *ends[: count - 1]], ends[-count:])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in spans), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, _HASHES):
        part = hashes[start : start + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def with_fingerprint(text_col: str, shingle: int) -> Column:
    """LONG column: the fingerprint's 64 bits."""

    @F.arrow_udf("long")
    def bits(text: pa.Array) -> pa.Array:
        kind = pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()
        found = [fingerprint(x, shingle) for x in text.cast(kind).to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return bits(F.col(text_col))


def _buckets(distinct: int, radius: int) -> Column:
    """Array of bucket numbers of a fingerprint ``f``; close fingerprints share one at least."""
    blocks = radius + 1
    width = 64 // blocks
    wanted = max(0, (max(distinct, 1) // TILE).bit_length())
    bits = min(wanted, width)
    if not bits:
        return F.array(F.lit(0).cast("long"))
    inner = (64 - width) // blocks
    more = min(max(0, wanted - width), inner)
    f, found = F.col("f"), []
    for i in range(blocks):
        value = F.shiftrightunsigned(f, i * width).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        if not more:
            found.append(F.shiftleft(value, 8) + i)
            continue
        low = f.bitwiseAND(F.lit((1 << (i * width)) - 1).cast("long"))
        above = (i + 1) * width
        high = F.shiftleft(F.shiftrightunsigned(f, above), i * width) if above < 64 else F.lit(0).cast("long")
        rest = high.bitwiseOR(low)
        for j in range(blocks):
            second = F.shiftrightunsigned(rest, j * inner).bitwiseAND(F.lit((1 << more) - 1).cast("long"))
            found.append(F.shiftleft(F.shiftleft(value, more) + second, 8) + (i * blocks + j))
    return F.array(*found)


def _close(left: np.ndarray, right: np.ndarray, radius: int):
    """Index pairs within the radius. Both sides are sorted by population count."""
    weight, other = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    for start in range(0, len(left), _ROWS):
        rows = left[start : start + _ROWS]
        first = np.searchsorted(other, weight[start] - radius, "left")
        last = np.searchsorted(other, weight[start + len(rows) - 1] + radius, "right")
        if first < last:
            near = np.bitwise_count(rows[:, None] ^ right[None, first:last]) <= radius
            a, b = np.nonzero(near)
            yield a + start, b + first


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Member and smallest member of each group of linked fingerprints, leaving out the smallest itself."""
    everything = np.unique(np.concatenate([left, right]))
    sides = []
    for side in (left, right):
        side = side[np.argsort(np.bitwise_count(side), kind="stable")]
        sides.append((side, np.searchsorted(everything, side)))
    label = np.arange(len(everything))
    (one, place_one), (two, place_two) = sides
    for a, b in _close(one, two, radius):
        u, v = place_one[a], place_two[b]
        while len(u):
            x, y = label[u], label[v]
            apart = x != y
            if not apart.any():
                break
            u, v, x, y = u[apart], v[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    moved = np.nonzero(label != np.arange(len(everything)))[0]
    return everything[moved], everything[label[moved]]


def _links(distinct: DataFrame, count: int, radius: int) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``f`` that connect all that are within the radius."""
    entries = distinct.select("f", F.explode(_buckets(count, radius)).alias("bucket")).withColumn(
        "weight", F.bit_count("f")
    )
    large = (
        entries.groupBy("bucket", "weight").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bucket").agg(F.sum("n").alias("members"), F.max("n").alias("most"))
        .filter(F.col("members") > _ONE_PIECE)
        .select("bucket", F.ceil(F.col("most") / TILE).cast("int").alias("parts"))
    )
    placed = entries.join(large, "bucket", "left").withColumn(
        "part", F.pmod(F.xxhash64("f", "bucket"), F.coalesce("parts", F.lit(1))).cast("int")
    )
    # A tile pair is (weight, part) x (weight, part), the smaller first; a tile meets itself on side 2.
    pairs = f"""
        CASE WHEN parts IS NULL THEN array(named_struct('w', 0, 'p', 0, 'x', 0, 'q', 0, 'side', 2))
        ELSE flatten(transform(sequence(-{radius}, {radius}), d -> transform(sequence(0, parts - 1), o ->
            CASE WHEN d > 0 OR (d = 0 AND o > part)
                 THEN named_struct('w', weight, 'p', part, 'x', weight + d, 'q', o, 'side', 0)
                 WHEN d = 0 AND o = part
                 THEN named_struct('w', weight, 'p', part, 'x', weight, 'q', part, 'side', 2)
                 ELSE named_struct('w', weight + d, 'p', o, 'x', weight, 'q', part, 'side', 1) END)))
        END"""

    def compare(table: pa.Table) -> pa.Table:
        prints = table.column("f").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        u, v = _forest(prints[side != 1], prints[side != 0], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    units = placed.select("f", "bucket", F.explode(F.expr(pairs)).alias("unit")).select("f", "bucket", "unit.*")
    return units.groupBy("bucket", "w", "p", "x", "q").applyInArrow(compare, "u long, v long")


def _winners(prints: DataFrame, radius: int) -> DataFrame:
    """``f, doc_id, row_no`` per distinct fingerprint: the first row of its component.

    ``prints``: ``f, doc_id, row_no``, stored. Rows come in order of ``doc_id``
    (NULL last), then of ``row_no``.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("first")
    distinct = stored(prints.groupBy("f").agg(first), "fingerprints")
    return _first_of_components(distinct, smallest_reachable(_links(distinct.select("f"), distinct.count(), radius)))


def _first_of_components(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``f, doc_id, row_no``. ``edges`` have ``u`` linked to the smallest of its component ``v``."""
    root = edges.select(F.col("u").alias("f"), F.col("v").alias("root"))
    rooted = distinct.join(root, "f", "left").withColumn("root", F.coalesce("root", "f"))
    components = totals_apart(rooted, ["root"], F.min("first").alias("winner"))
    return rooted.join(components, "root").select("f", "winner.doc_id", "winner.row_no")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    ship(docs.sparkSession)
    prints = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            with_fingerprint(text_col, shingle).alias("f"),
        ).withColumn("row_no", F.lit(0).cast("long")),
        "prints",
    )
    winners = _winners(prints, radius).select("f", F.col("doc_id").alias("component_id"))
    return prints.join(winners, "f").select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: the first of each component."""
    ship(docs.sparkSession)
    rows = stored(
        docs.select(
            F.struct("*").alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            with_fingerprint(text_col, shingle).alias("f"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "prints",
    )
    winners = _winners(rows.select("f", "doc_id", "row_no"), radius).select("row_no").distinct()
    return rows.join(winners, "row_no", "left_semi").select("row.*")
