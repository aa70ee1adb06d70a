"""Exact deduplication by Patricia-trie owners.

Every input partition puts its whole normalised texts into a radix trie whose
terminals hold the smallest identifier and the number of rows, so a group of
copies leaves a partition as one row. These rows meet, by length and content
hash, at their owner: one more trie over full byte strings that merges the
terminals. Neither trie outgrows ``memory``: the first passes all its subtrees
on as partial terminals, the second, whose input comes sorted, gives out the
subtrees that lie wholly before the present length and hash.

Defined cases: a NULL text counts as empty. A NULL identifier comes after all
others, so such a row stays only if its group has no identifier at all. If rows
repeat the smallest identifier of a group, one of them stays. An empty table
gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.patricia import PatriciaTrie
from tillwise.llm.runtime import bound_batches, ship

# Bytes that a task's trie may hold before it passes subtrees on.
TRIE_BYTES = 96 << 20

# Copies of one (identifier, text) pair are listed again in blocks of this many.
_BLOCK = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; NULL as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def normalised_bytes(text: bytes | None) -> bytes:
    """The same as :func:`normalised`, on UTF-8 bytes. ``bytes.split`` knows the same six characters."""
    if not text:
        return b""
    inner = b" ".join(text.split())
    if not inner:
        return b" "
    return (b" " if text[:1].isspace() else b"") + inner + (b" " if text[-1:].isspace() else b"")


def _address(data: bytes) -> tuple[int, int]:
    """Length and signed 64-bit content hash: where the owner of a text is."""
    return len(data), xxhash.xxh64_intdigest(data) - (1 << 63)


class _Terminals:
    """A trie with the input batches that its terminals point into.

    A terminal is ``[identifier, rows, batch number, row, *more]``.
    """

    def __init__(self, id_field: str, text_field: str, memory: int):
        self.id_field, self.text_field, self.memory = id_field, text_field, memory
        self.trie, self.batches, self.number = PatriciaTrie(), {}, -1

    def open(self, batch: pa.RecordBatch) -> tuple[list, list]:
        rows = batch.column("row")
        self.number += 1
        self.batches[self.number] = rows
        text = pc.struct_field(rows, self.text_field)
        kind = pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()
        return pc.struct_field(rows, self.id_field).to_pylist(), text.cast(kind).to_pylist()

    def put(self, key: bytes, identifier, count: int, row: int, *more) -> None:
        new = [identifier, 0, self.number, row, *more]
        held = self.trie.find_or_add(key, new)
        held[1] += count
        if held is not new and self._earlier(identifier, row, held):
            held[0], held[2], held[3] = identifier, self.number, row

    def _earlier(self, identifier, row: int, held: list) -> bool:
        if identifier == held[0]:  # of rows that repeat an identifier the choice must not depend on their order
            mine, other = self.batches[self.number][row], self.batches[held[2]][held[3]]
            return repr(mine.as_py()) < repr(other.as_py())
        return held[0] is None or (identifier is not None and identifier < held[0])

    def full(self) -> bool:
        return self.trie.bytes + sum(x.nbytes for x in self.batches.values()) > self.memory

    def give(self, values: Iterator[list], columns) -> Iterator[pa.RecordBatch]:
        """Batches with the winning row and what ``columns`` makes of the terminals."""
        by_batch: dict[int, list[list]] = {}
        for value in values:
            by_batch.setdefault(value[2], []).append(value)
        for number, found in by_batch.items():
            rows = self.batches[number].take(pa.array([x[3] for x in found], pa.int64()))
            yield pa.RecordBatch.from_pydict({"row": rows, **columns(found)})

    def forget(self, keep: set[int]) -> None:
        self.batches = {n: x for n, x in self.batches.items() if n in keep}


def _partial_columns(found: list[list]) -> dict[str, pa.Array]:
    return {
        "length": pa.array([x[4] for x in found], pa.int64()),
        "content": pa.array([x[5] for x in found], pa.int64()),
        "copies": pa.array([x[1] for x in found], pa.int64()),
    }


def _combine(id_field: str, text_field: str, memory: int):
    """Within an input partition: one partial terminal for each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Terminals(id_field, text_field, memory)
        for batch in batches:
            identifiers, texts = held.open(batch)
            for row, (identifier, text) in enumerate(zip(identifiers, texts)):
                data = normalised_bytes(text)
                length, content = _address(data)
                held.put(data, identifier, 1, row, length, content)
            if held.full():
                yield from held.give(held.trie.take_all(), _partial_columns)
                held.forget(set())
        yield from held.give(held.trie.take_all(), _partial_columns)

    return run


def _owner_columns(found: list[list]) -> dict[str, pa.Array]:
    return {
        "keep_id": pa.array([x[0] for x in found], pa.int64()),
        "group_size": pa.array([x[1] for x in found], pa.int64()),
        "text_sha256": pa.array([x[4] for x in found], pa.string()),
    }


def _own(id_field: str, text_field: str, memory: int):
    """At an owner: merge the partial terminals of equal texts. Input is sorted by length and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Terminals(id_field, text_field, memory)
        for batch in batches:
            identifiers, texts = held.open(batch)
            places = zip(batch.column("length").to_pylist(), batch.column("content").to_pylist())
            place = b""
            for row, (identifier, text, count, (length, content)) in enumerate(
                zip(identifiers, texts, batch.column("copies").to_pylist(), places)
            ):
                data = normalised_bytes(text)
                place = length.to_bytes(8, "big") + (content + (1 << 63)).to_bytes(8, "big")
                held.put(place + data, identifier, count, row, hashlib.sha256(data).hexdigest())
            if held.full():
                yield from held.give(held.trie.take_before(place), _owner_columns)
                held.forget({value[2] for value in held.trie.values()})
        yield from held.give(held.trie.take_all(), _owner_columns)

    return run


def _owners(rows: DataFrame, id_field: str, text_field: str, memory: int) -> DataFrame:
    """``row, keep_id, group_size, text_sha256`` per distinct text; ``row`` is the row that stays."""
    bound_batches(ship(rows.sparkSession))
    row = rows.schema["row"]
    partial = T.StructType([
        row,
        T.StructField("length", T.LongType()),
        T.StructField("content", T.LongType()),
        T.StructField("copies", T.LongType()),
    ])
    owner = T.StructType([
        row,
        T.StructField("keep_id", T.LongType()),
        T.StructField("group_size", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
    ])
    return (
        rows.mapInArrow(_combine(id_field, text_field, memory), partial)
        .repartition("length", "content")
        .sortWithinPartitions("length", "content")
        .mapInArrow(_own(id_field, text_field, memory), owner)
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one per distinct normalised text.

    The rows travel with their terminals, so the whole job is one shuffle of the
    distinct texts.
    """
    kept = _owners(docs.select(F.struct("*").alias("row")), id_col, text_col, memory)
    return kept.select("row.*")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = TRIE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Owners give one row per distinct text. Document rows find theirs by SHA-256;
    they are narrow by then, and the join can be split where a group is hot.
    """
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    owners = _owners(bare.select(F.struct("*").alias("row")), "doc_id", "text", memory).drop("row")
    pairs = (
        bare.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
        .groupBy("doc_id", "text_sha256")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / _BLOCK)))
    last = F.least(F.col("rows") - 1, (F.col("block") + 1) * _BLOCK - 1)
    return (
        pairs.join(owners, "text_sha256")
        .select("*", block.alias("block"))
        .select("*", F.explode(F.sequence(F.col("block") * _BLOCK, last)).alias("copy"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
            "text_sha256",
        )
    )
