"""Fill-in-middle transformation by block rotations in place.

A text becomes a byte array. Its tokens (runs of ASCII letters, or single other
characters) are counted block by block, two cuts are placed by a hash of the
identifier, and the three sentinels are inserted at the cuts. The order of the
segments is then changed inside the array: a rotation exchanges two neighbouring
blocks by reversing each of them and both together, with a buffer of fixed size.

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is

:func:`restore` needs the output and its form only: it finds the sentinels,
rotates the blocks back and takes the sentinels out. That is exact, because a text
with a sentinel in it stays plain, and because two sentinels can't overlap.

Defined cases: a NULL text counts as empty; empty texts are plain. A NULL
identifier is hashed as the seed alone, so rows without one share their draws.
Repeated rows are transformed alike. Bytes that are not UTF-8 are carried as they
are. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.runtime import bound_batches, ship

# Texts are scanned and reversed by blocks of so many bytes.
BLOCK = 1 << 20
# Bytes of output that are given on at once.
_FLUSH = 1 << 22


class Rule(NamedTuple):
    """How texts are cut: seed of the hash, share of plain texts and of spm among the others (in percent), sentinels."""

    seed: str = "1"
    plain: int = 10
    spm: int = 20
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def draws(self, identifier: int | None) -> tuple[int, ...]:
        key = f"{self.seed}:{'' if identifier is None else identifier}"
        digits = hashlib.sha256(key.encode()).hexdigest()
        return tuple(int(digits[at : at + 8], 16) for at in (0, 8, 16, 24))

    def sentinels(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle


class Transformed(NamedTuple):
    output: bytearray
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None


def _continues(block: np.ndarray) -> np.ndarray:
    """Which bytes continue a character."""
    return (block & 0xC0) == 0x80


class Tokens:
    """Counts the tokens of a byte string and finds where the n-th begins, a block at a time."""

    def __init__(self, data: bytes | bytearray, block: int = BLOCK):
        self.data, self.block = np.frombuffer(data, np.uint8), block
        counts = (np.count_nonzero(self._begins(at)) for at in range(0, len(self.data), block))
        self.before = [0, *accumulate(int(count) for count in counts)]
        self.n = self.before[-1]

    def _begins(self, at: int) -> np.ndarray:
        part = self.data[max(0, at - 1) : at + self.block]
        letter = ((part | 0x20) - np.uint8(97)) < 26
        begins = ~_continues(part)
        begins[1:] &= ~(letter[1:] & letter[:-1])
        return begins[1:] if at else begins

    def place(self, number: int) -> int:
        """Byte at which token ``number`` begins; the end for the number of tokens."""
        if number >= self.n:
            return len(self.data)
        low, high = 0, len(self.before) - 1
        while high - low > 1:
            half = (low + high) // 2
            low, high = (half, high) if self.before[half] <= number else (low, half)
        found = np.flatnonzero(self._begins(low * self.block))
        return low * self.block + int(found[number - self.before[low]])

    def characters(self, start: int, end: int) -> int:
        return sum(
            int(np.count_nonzero(~_continues(self.data[at : min(end, at + self.block)])))
            for at in range(start, end, self.block)
        )


def _reverse(view: np.ndarray, start: int, end: int) -> None:
    while end - start > 1:
        step = min(BLOCK, (end - start) // 2)
        front = view[start : start + step][::-1].copy()
        view[start : start + step] = view[end - step : end][::-1]
        view[end - step : end] = front
        start, end = start + step, end - step


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the blocks ``start:cut`` and ``cut:end`` inside ``buffer`` by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, start, cut)
    _reverse(view, cut, end)
    _reverse(view, start, end)


def transform(data: bytes, identifier: int | None, rule: Rule = Rule()) -> Transformed:
    tokens = Tokens(data)
    one, two, plain, kind = rule.draws(identifier)
    if not data or plain % 100 >= 100 - rule.plain or any(mark in data for mark in rule.sentinels()):
        return Transformed(bytearray(data), tokens.n, "plain", None, None)
    first, second = sorted((one % (tokens.n + 1), two % (tokens.n + 1)))
    cut, end = tokens.place(first), tokens.place(second)
    buffer = bytearray(data)
    # prefix, middle, suffix, each behind its sentinel
    buffer[end:end] = rule.suffix
    buffer[cut:cut] = rule.middle
    buffer[0:0] = rule.prefix
    middle = cut + len(rule.prefix)
    suffix = end + len(rule.prefix) + len(rule.middle)
    form = "spm" if kind % 100 < rule.spm else "psm"
    rotate(buffer, 0 if form == "spm" else middle, suffix, len(buffer))
    return Transformed(buffer, tokens.n, form, tokens.characters(0, cut), tokens.characters(cut, end))


def restore(output: bytes, form: str, rule: Rule = Rule()) -> bytearray:
    """The text that ``output`` was made of."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    prefix, suffix, middle = (buffer.find(mark) for mark in rule.sentinels())
    length = len(buffer)
    if form == "spm":
        # suffix | prefix, middle: the suffix goes back behind the others
        rotate(buffer, 0, prefix, length)
        middle, suffix = middle - prefix, length - prefix
    else:
        # prefix | suffix | middle: the last two change places
        rotate(buffer, suffix, middle, length)
        middle, suffix = suffix, suffix + length - middle
    for at, mark in ((suffix, rule.suffix), (middle, rule.middle), (0, rule.prefix)):
        del buffer[at : at + len(mark)]
    return buffer


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]


def _transform_batches(rule: Rule):
    def flush(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), _KINDS)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for identifier, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = transform(text.as_py() or b"", identifier, rule)
                made.append((identifier, found.n, found.form, found.prefix_chars, found.middle_chars, bytes(found.output)))
                size += len(found.output)
                if size >= _FLUSH:
                    yield flush(made)
                    made, size = [], 0
            if made:
                yield flush(made)

    return run


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``. Nothing is shuffled."""
    bound_batches(ship(docs.sparkSession))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(_transform_batches(rule), _SCHEMA)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that each row's output was made of."""

    @F.arrow_udf("binary")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        texts = (bytes(restore(o.as_py(), f.as_py(), rule)) for o, f in zip(outputs, forms))
        return pa.array(texts, pa.binary())

    return back(output.cast("binary"), form).cast("string")


def transformation_digests(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` for every row of ``docs``."""
    made = fill_in_middle(docs, rule)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), rule), 256).alias("restored_sha256"),
    )
