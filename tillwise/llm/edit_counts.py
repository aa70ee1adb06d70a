"""Token counts that follow edits.

A document is kept as a segment tree over its pre-token pieces: leaves hold
short runs of pieces with their token counts, inner nodes the sums of characters
and tokens below them. An edit finds its place by descending the character
sums. Re-encoding begins at the first piece that could have seen the edited
characters (a piece is settled once two more characters behind it are the same)
and ends where new and old piece borders fall together behind the edit; only
those pieces are split and counted again, and the sums above their leaves are
updated. The total is the root's sum.

Trees are kept: :func:`keep_trees` makes a table with each document's text, the
lengths of its pieces and their token counts, and :func:`edit_trees` starts from
such a table, applies a batch of edits, and gives the table as it is afterwards. So
the next batch encodes what it touches and nothing else.

Edits come as ``start, end, replacement`` on the original text, in characters,
not overlapping; they are applied from the last to the first, so that places
stay valid.

Defined cases: a NULL or empty text has no pieces and no tokens; edits may
insert into it. NULL edits are none. Edits may touch each other; insertions at
the same place keep their order. Rows with NULL or repeated identifiers are
counted like any other. An empty table gives an empty result. Other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.lm_scoring import Tokens, load_ranks
from tillwise.llm.runtime import ship, stored

# Pieces of a new leaf, and how far a leaf may grow before the tree is laid out anew.
LEAF = 64
_FULL = 8 * LEAF

# Pieces a task remembers the token count of; longer pieces are not remembered.
_REMEMBERED = 1 << 18
_LONGEST = 64

# How far behind its end a piece's split can look.
_AHEAD = 2

Edit = tuple[int, int, str]


class PieceCounter:
    """Splits text into pre-token pieces and counts the tokens of a piece."""

    def __init__(self, tokens: Tokens):
        self.pattern = regex.compile(tokens.pattern)
        self.encode = tokens.encoding().encode_ordinary
        self._known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _new(self, piece: str) -> int:
        found = len(self.encode(piece))
        if len(piece) <= _LONGEST:
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            self._known[piece] = found
        return found

    def counts(self, pieces: list[str]) -> list[int]:
        known = self._known
        return [known.get(piece) or self._new(piece) for piece in pieces]


class PieceTree:
    """Segment tree over the pieces of one text. ``recounted`` says how many pieces edits have touched."""

    def __init__(self, text: str, counter: PieceCounter):
        pieces = counter.split(text)
        self._start(pieces, counter.counts(pieces), counter)

    @classmethod
    def kept(cls, text: str, lengths: list[int], counts: list[int], counter: PieceCounter) -> PieceTree:
        """A tree of pieces that have been counted before."""
        tree = cls.__new__(cls)
        tree._start([text[end - length : end] for end, length in zip(accumulate(lengths), lengths)], counts, counter)
        return tree

    def _start(self, pieces: list[str], counts: list[int], counter: PieceCounter) -> None:
        self.counter = counter
        self.recounted = 0
        self._lay_out(pieces, counts)

    def state(self) -> tuple[str, list[int], list[int]]:
        """Text, lengths of the pieces and their counts, as :meth:`kept` takes them."""
        pieces = [piece for leaf, _ in self.leaves for piece in leaf]
        return "".join(pieces), list(map(len, pieces)), [count for _, leaf in self.leaves for count in leaf]

    def _lay_out(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = [
            (pieces[at : at + LEAF], counts[at : at + LEAF]) for at in range(0, len(pieces), LEAF)
        ] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for number in range(len(self.leaves)):
            self._sum_leaf(number)
        for node in range(self.width - 1, 0, -1):
            self._sum_node(node)

    def _sum_leaf(self, number: int) -> None:
        pieces, counts = self.leaves[number]
        self.chars[self.width + number] = sum(map(len, pieces))
        self.tokens[self.width + number] = sum(counts)

    def _sum_node(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(piece for pieces, _ in self.leaves for piece in pieces)

    def _find(self, place: int) -> tuple[int, int]:
        """Leaf that has character ``place`` (the last leaf beyond the end), and where that leaf begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place - begin >= self.chars[node] and begin + self.chars[node] < self.chars[1]:
                begin += self.chars[node]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), begin

    def apply(self, start: int, end: int, replacement: str) -> None:
        """Replace characters ``start`` to ``end`` of the present text."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError(f"edit {start}:{end} is outside of a text of {self.chars[1]} characters")
        first, begin = self._find(max(0, start - _AHEAD))
        kept, kept_counts = [], []
        for piece, count in zip(*self.leaves[first]):
            if begin + len(piece) + _AHEAD > start:
                break
            kept.append(piece)
            kept_counts.append(count)
            begin += len(piece)
        # From here on everything may be split anew. Old pieces are read leaf by leaf until borders meet.
        old = list(self.leaves[first][0][len(kept) :])
        old_counts = list(self.leaves[first][1][len(kept) :])
        last, length = first, sum(map(len, old))
        while True:
            complete = last == len(self.leaves) - 1
            if begin + length >= end or complete:
                before = "".join(old)
                window = before[: start - begin] + replacement + before[end - begin :]
                made, met = self._meet(window, old, end - begin, len(window) - len(before), complete)
                if met is not None:
                    break
            last += 1
            more = self.leaves[last]
            old += more[0]
            old_counts += more[1]
            length += sum(map(len, more[0]))
        self.recounted += len(made)
        pieces = kept + made + old[met:]
        counts = kept_counts + self.counter.counts(made) + old_counts[met:]
        self._store(first, last, pieces, counts)

    def _meet(self, window: str, old: list[str], end: int, shift: int, complete: bool) -> tuple[list[str], int | None]:
        """New pieces up to a border that was one before, and the number of old pieces in front of it."""
        borders, at = {}, 0
        for number, piece in enumerate(old):
            if at >= end:
                borders[at + shift] = number
            at += len(piece)
        made, at = [], 0
        safe = len(window) if complete else len(window) - _AHEAD
        for found in self.counter.pattern.finditer(window):
            if found.start() in borders and found.start() >= end + shift:
                return made, borders[found.start()]
            if found.end() > safe:
                return made, None
            made.append(found.group())
        return (made, len(old)) if complete else (made, None)

    def _store(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        slots = last - first + 1
        share = -(-len(pieces) // slots) if pieces else 0
        for number in range(slots):
            cut = slice(number * share, (number + 1) * share)
            self.leaves[first + number] = (pieces[cut], counts[cut])
            self._sum_leaf(first + number)
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for node in range(low, high + 1):
                self._sum_node(node)
            low, high = low // 2, high // 2
        if share > _FULL:
            self._lay_out(
                [piece for leaf, _ in self.leaves for piece in leaf],
                [count for _, leaf in self.leaves for count in leaf],
            )

    def apply_all(self, edits: Iterable[Edit]) -> int:
        """Apply edits given on the original text; their number."""
        ordered = sorted(enumerate(edits), key=lambda item: (item[1][0], item[1][1], item[0]))
        for (_, (_, end, _)), (_, (start, _, _)) in zip(ordered, ordered[1:]):
            if start < end:
                raise ValueError("edits overlap")
        for _, (start, end, replacement) in reversed(ordered):
            self.apply(start, end, replacement)
        return len(ordered)


_PRIVATE = re.compile(
    r'(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)'
    r'|(?P<address>\b\d{1,3}(?:\.\d{1,3}){3}\b)'
    r'|(?P<number>\b\d{12,19}\b)'
    r'|(?P<secret>(?i:token|secret|password|key)\s*[=:]\s*"[^"\s]{8,}")'
)


def private_data(text: str | None) -> list[Edit]:
    """Edits that put placeholders for mail and network addresses, long numbers and quoted secrets."""
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in _PRIVATE.finditer(text)] if text else []


_EDITS = "array<struct<start:int,end:int,replacement:string>>"
_TREE = "doc_id long, text string, lengths binary, counts binary"
_COUNTED = "n_tokens long, n_edits int, edited_n_tokens long, recounted_pieces int, n_pieces int"
_TREE_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
_COUNTED_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
_EDIT_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))
# Characters of text that are given on at once.
_FLUSH = 1 << 23
_counters: dict[int, PieceCounter] = {}


def _counter(tokens) -> PieceCounter:
    """One counter for each Python worker, which remembers pieces from batch to batch."""
    found = _counters.get(id(tokens.value))
    if found is None:
        found = _counters[id(tokens.value)] = PieceCounter(tokens.value)
    return found


def packed(numbers: list[int]) -> bytes:
    """Numbers of pieces as they are kept: compressed 32-bit integers."""
    return zstandard.compress(np.array(numbers, "<u4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4")


def _flushed(rows: Iterator[tuple[int, tuple]], schema: str, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows, each behind its size, as batches of bounded size."""
    names, made, size = [part.split()[0] for part in schema.split(", ")], [], 0
    for length, row in rows:
        made.append(row)
        size += length
        if size >= _FLUSH or len(made) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names)
            made, size = [], 0
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names)


def _keep_batches(tokens, schema: str):
    def rows(batches):
        counter = _counter(tokens)
        for batch in batches:
            for identifier, text, *edits in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                text = text.as_py() or ""
                pieces = counter.split(text)
                tree = identifier, text, packed(list(map(len, pieces))), packed(counter.counts(pieces))
                yield len(text), (*tree, *(x.as_py() for x in edits))

    return lambda batches: _flushed(rows(batches), schema, [*_TREE_KINDS, _EDIT_KIND])


def _edit_batches(tokens, rule: Callable[[str | None], list[Edit]] | None, keep: bool):
    def rows(batches):
        counter = _counter(tokens)
        for batch in batches:
            for place, identifier in enumerate(batch.column(0).to_pylist()):
                text, lengths, counts = (batch.column(column)[place].as_py() for column in (1, 2, 3))
                edits = batch.column(4)[place].as_py() if rule is None else rule(text)
                edits = [tuple(edit.values()) if isinstance(edit, dict) else edit for edit in edits or []]
                counted = unpacked(counts)
                before = after = int(counted.sum())
                touched, pieces = 0, len(counted)
                if edits:
                    tree = PieceTree.kept(text, unpacked(lengths).tolist(), counted.tolist(), counter)
                    tree.apply_all(edits)
                    after, touched = tree.n_tokens, tree.recounted
                    if keep:
                        text, new_lengths, new_counts = tree.state()
                        lengths, counts = packed(new_lengths), packed(new_counts)
                numbers = before, len(edits), after, touched, pieces
                yield (len(text), (identifier, text, lengths, counts, *numbers)) if keep else (0, (identifier, *numbers))

    if keep:
        return lambda batches: _flushed(rows(batches), f"{_TREE}, {_COUNTED}", _TREE_KINDS + _COUNTED_KINDS)
    return lambda batches: _flushed(rows(batches), f"doc_id long, {_COUNTED}", [pa.int64(), *_COUNTED_KINDS])


def _tokens_of(spark, ranks_path: str, pattern: str):
    return ship(spark).sparkContext.broadcast(Tokens(load_ranks(ranks_path), pattern))


def keep_trees(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    edits_col: str | None = None,
) -> DataFrame:
    """``doc_id, text, lengths, counts`` for every row of ``docs``: its pieces, split and counted once.

    ``lengths`` and ``counts`` have a number per piece, see :func:`unpacked`.

    The table is meant to be written, and to be edited from there. ``edits_col`` names
    a column of edits to keep beside the tree, as ``edits``. ``ranks_path`` is read on
    the driver.
    """
    tokens = _tokens_of(docs.sparkSession, ranks_path, pattern)
    columns, schema = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], _TREE
    if edits_col is not None:
        columns.append(F.col(edits_col).cast(_EDITS).alias("edits"))
        schema += f", edits {_EDITS}"
    return docs.select(*columns).mapInArrow(_keep_batches(tokens, schema), schema)


def edit_trees(
    trees: DataFrame,
    ranks_path: str,
    pattern: str,
    rule: Callable[[str | None], list[Edit]] | None = None,
    edits_col: str = "edits",
    keep: bool = True,
) -> DataFrame:
    """``trees`` after a batch of edits, with ``n_tokens`` before them, ``n_edits, edited_n_tokens, recounted_pieces, n_pieces``.

    Edits come from ``rule(text)``, or from the column ``edits_col`` of type
    ``array<struct<start:int,end:int,replacement:string>>``. Only pieces that edits
    touch are encoded, with the tokenizer that the trees were made with. No row meets
    another, so there is nothing to shuffle. ``keep=False`` gives ``doc_id`` and the
    numbers only.
    """
    tokens = _tokens_of(trees.sparkSession, ranks_path, pattern)
    columns = ["doc_id", "text", "lengths", "counts"]
    if rule is None:
        columns.append(F.col(edits_col).cast(_EDITS).alias("edits"))
    schema = f"{_TREE}, {_COUNTED}" if keep else f"doc_id long, {_COUNTED}"
    return trees.select(*columns).mapInArrow(_edit_batches(tokens, rule, keep), schema)


def count_edited(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    rule: Callable[[str | None], list[Edit]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    edits_col: str = "edits",
) -> DataFrame:
    """``doc_id, n_tokens, n_edits, edited_n_tokens, recounted_pieces, n_pieces`` for every row of ``docs``.

    The trees are written to the shared folder, and the edits are applied to those.
    """
    trees = keep_trees(docs, ranks_path, pattern, id_col, text_col, edits_col if rule is None else None)
    return edit_trees(stored(trees, "trees"), ranks_path, pattern, rule, keep=False)
