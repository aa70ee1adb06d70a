"""Benchmark decontamination with spaced seeds.

An overlap is an aligned pair of token windows, ``window`` tokens long (the
whole item if it is shorter), of which at least ``similarity`` agree; other
tokens may be substituted. Seeds find where to look: fixed masks over the
tokens, some positions of which are ignored. A window with ``k`` substitutions
is cut into ``k + 2`` parts, of which two stay whole, so the masks are two parts
at each possible distance, and no overlap is missed. Masked hashes of the
benchmark are joined with masked hashes at every token of every document; each
hit names an item and an alignment, along which all windows are then compared
token by token.

The benchmark is the join's small side by an explicit bound: it is broadcast in
blocks of about ``BLOCK_BYTES`` of text, and the documents are read once for
each block.

Tokens are runs of word characters, lower-cased; in scripts that write no spaces
between words each character is a token. Items of equal text are one class, found
once; :func:`item_classes` says which items a class has.

Defined cases: NULL and empty texts, of documents or items, and texts without a word
character have no overlaps. In an item of fewer than five tokens no substitution is
allowed (four of four is the least number above ``similarity``), so it has to occur
word for word, which a very short one easily does; of its places in a document the
first is reported. Rows with NULL or repeated identifiers are looked at like any
other. An empty table on either side gives no overlaps. Other columns may have any
name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.runtime import ship, stored
from tillwise.plans.sales import totals_apart

WINDOW = 13
SIMILARITY = 0.8
BLOCK_BYTES = 16 << 20

# Scripts without spaces between words (Thai, Lao, Tibetan, Burmese, Khmer, kana, ideographs).
_UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
_TOKEN = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")
# Tokens that are looked at in one go; a longer document is a go of its own.
_GO = 1 << 19
_FILTER_BITS = 22


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def needed(window: int, similarity: float = SIMILARITY) -> int:
    """Tokens of a window that have to agree."""
    return -(-round(window * similarity * 1000) // 1000)


def masks(window: int, substitutions: int) -> list[tuple[int, ...]]:
    """Positions that each mask looks at, such that some mask misses every choice of substitutions."""
    if substitutions == 0:
        return [tuple(range(window))]
    parts = substitutions + 2
    size = window // parts
    return [(*range(size), *range(gap * size, (gap + 1) * size)) for gap in range(1, parts)]


def _hashes(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the masked tokens at every position where the mask fits."""
    count = len(tokens) - mask[-1]
    if count <= 0:
        return np.zeros(0, np.uint64)
    found = np.full(count, len(mask) * 1_000_003 + mask[-1], np.uint64)
    for offset in mask:
        found = (found ^ tokens[offset : offset + count]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


class SeedIndex:
    """Masked hashes of benchmark items, and the items for the comparison."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW, similarity: float = SIMILARITY):
        self.words: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray, int, int]] = []
        entries: dict[tuple[int, ...], list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            found = tokens_of(text)
            if not found:
                continue
            tokens = np.array([self.words.setdefault(word, len(self.words) + 1) for word in found], np.uint64)
            length = min(window, len(tokens))
            least = needed(length, similarity)
            for mask in masks(length, length - least):
                entries.setdefault(mask, []).append((_hashes(tokens, mask), len(self.items)))
            self.items.append((item_id, tokens, length, least))
        # Items whose only window is the item itself, word for word: padded to one width for the comparison.
        self.exact = np.array([least == len(tokens) for _, tokens, _, least in self.items], bool)
        self.sizes = np.array([len(tokens) for _, tokens, _, _ in self.items], np.int64)
        self.seeds = []
        for mask, found in entries.items():
            keys = np.concatenate([keys for keys, _ in found])
            owner = np.concatenate([np.full(len(keys), item, np.int32) for keys, item in found])
            place = np.concatenate([np.arange(len(keys), dtype=np.int32) for keys, _ in found])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.seeds.append((mask, keys[order], owner[order], place[order], seen))

    def _alignments(self, tokens: np.ndarray) -> np.ndarray:
        """Rows ``position - place, item`` of all seed hits, each once."""
        found = [np.zeros((0, 2), np.int64)]
        for mask, keys, owner, place, seen in self.seeds:
            hashes = _hashes(tokens, mask)
            at = np.nonzero(seen[hashes >> np.uint64(64 - _FILTER_BITS)])[0]
            first = np.searchsorted(keys, hashes[at], "left")
            count = np.searchsorted(keys, hashes[at], "right") - first
            at, first, count = at[count > 0], first[count > 0], count[count > 0]
            if len(at):
                entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                found.append(np.stack([np.repeat(at, count) - place[entry], owner[entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """``document, item, first token, tokens, agreeing tokens, first token in the item`` of each overlap.

        Overlapping windows of one alignment are one overlap.
        """
        start = 0
        while start < len(texts):
            lists, size, end = [], 0, start
            while end < len(texts) and (size < _GO or end == start):
                lists.append(tokens_of(texts[end]))
                size += len(lists[-1])
                end += 1
            yield from self._go(lists, start)
            start = end

    def _go(self, lists: list[list[str]], first: int):
        gap = np.zeros(WINDOW, np.uint64)  # keeps masks from reaching into the next document, mostly
        parts, starts, at = [], [], 0
        for found in lists:
            starts.append(at)
            parts += [np.fromiter(map(self.words.get, found, repeat(0)), np.uint64, len(found)), gap]
            at += len(found) + len(gap)
        tokens = np.concatenate(parts)
        hits = self._alignments(tokens)
        if not len(hits):
            return
        exact = self.exact[hits[:, 1]]
        yield from self._word_for_word(tokens, hits[exact], np.array(starts), np.array(list(map(len, lists))), first)
        for shift, item in hits[~exact].tolist():
            _, wanted, window, least = self.items[item]
            # an alignment may begin before the document that it is in
            for document in {
                int(np.searchsorted(starts, min(max(x, 0), at - 1), "right")) - 1
                for x in (shift, shift + len(wanted) - 1)
            } | set(range(*np.searchsorted(starts, [shift, shift + len(wanted)], "left"))):
                begin = starts[document]
                low, high = max(shift, begin), min(shift + len(wanted), begin + len(lists[document]))
                if high - low >= window:
                    same = tokens[low:high] == wanted[low - shift : high - shift]
                    for a, b in _runs(same, window, least):
                        agree = int(same[a:b].sum())
                        yield first + document, item, low - begin + a, b - a, agree, low - shift + a


    def _word_for_word(self, tokens: np.ndarray, hits: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int):
        """The first place in each document of each item that allows no substitution."""
        hits = hits[hits[:, 0] >= 0]
        document = np.searchsorted(starts, hits[:, 0], "right") - 1
        inside = hits[:, 0] + self.sizes[hits[:, 1]] <= starts[document] + lengths[document]
        hits, document = hits[inside], document[inside]
        _, once = np.unique(document * len(self.items) + hits[:, 1], return_index=True)
        for at in once.tolist():
            shift, item = hits[at].tolist()
            wanted = self.items[item][1]
            if (tokens[shift : shift + len(wanted)] == wanted).all():
                yield first + int(document[at]), item, shift - int(starts[document[at]]), len(wanted), len(wanted), 0


def _runs(same: np.ndarray, window: int, least: int) -> Iterator[tuple[int, int]]:
    """Unions of windows that agree enough, from their first to their last agreeing token."""
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.nonzero(total[window:] - total[:-window] >= least)[0]
    if not len(good):
        return
    breaks = np.nonzero(np.diff(good) > window)[0]
    for a, b in zip([0, *(breaks + 1)], [*breaks, len(good) - 1]):
        low, high = int(good[a]), int(good[b]) + window
        inside = np.nonzero(same[low:high])[0]
        yield low + int(inside[0]), low + int(inside[-1]) + 1


def item_classes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, class_id`` of every item that has a text: the smallest identifier of an equal text (NULL if none has one)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    classes = totals_apart(items, ["text"], F.min("item_id").alias("class_id"))
    return items.join(classes, "text").select("item_id", "class_id")


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, window: int, similarity: float):
    """Broadcast indexes of blocks of benchmark classes, one after the other."""
    spark = ship(benchmark.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    items = stored(items.groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text"), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        yield spark.sparkContext.broadcast(SeedIndex([tuple(row) for row in mine.collect()], window, similarity))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, doc_start, item_start, length, matches``: every overlap, places in tokens.

    ``item_id`` is the class of the item: the smallest identifier of an equal text.
    """
    schema = "doc_id long, item_id long, doc_start int, item_start int, length int, matches int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)

    def scan(index):
        def run(batches):
            for batch in batches:
                ids, made = batch.column(0).to_pylist(), []
                for document, item, start, length, matches, place in index.value.overlaps(batch.column(1).to_pylist()):
                    made.append((ids[document], index.value.items[item][0], start, place, length, matches))
                columns = list(zip(*made)) or [[]] * 6
                kinds = [pa.int64()] * 2 + [pa.int32()] * 4
                names = ["doc_id", "item_id", "doc_start", "item_start", "length", "matches"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        return run

    for index in _indexes(benchmark, item_col, item_text_col, window, similarity):
        found = found.union(rows.mapInArrow(scan(index), schema))
    return found


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without an overlap with the benchmark, all columns unchanged."""

    def clean(index):
        @F.arrow_udf("boolean")
        def check(text: pa.Array) -> pa.Array:
            texts = text.to_pylist()
            good = np.ones(len(texts), bool)
            for found in index.value.overlaps(texts):
                good[found[0]] = False
            return pa.array(good)

        return check(F.col(text_col))

    for index in _indexes(benchmark, item_col, item_text_col, window, similarity):
        docs = docs.filter(clean(index))
    return docs
