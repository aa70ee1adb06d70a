"""Periodic runs of words, found with string synchronising sets.

A run is a longest stretch of words that repeats with period ``q`` (its smallest)
at least four times. Texts of many documents are laid end to end as arrays of word
numbers, and all steps below are array operations over them.

* Periods 1 to 3: the highly periodic regions are found by comparing each word
  with the one 1, 2 or 3 places on.
* Periods from ``s`` to ``2s - 1``, for ``s = 4, 8, 16, ...``: position ``i`` is
  synchronising if, among the hashes of the stretches of ``s`` words that begin at
  ``i`` to ``i + s``, the least is the one at ``i`` or at ``i + s``. That depends on
  the ``2s`` words from ``i`` on only (the context), so the same context is chosen
  wherever it occurs. Stretches of ``s`` words with a period of ``s/4`` or less have no
  hash: they lie in runs that smaller scales have found, and would be chosen too
  often. Each two neighbouring positions with equal contexts propose their distance
  as a period; the words around them are compared to find where the run ends.

Why nothing is missed: let a run have period ``q`` with ``s <= q < 2s`` and four
times that length. Its first ``3s - 1`` words can't have a period of ``s/4``, or ``q``
would not be the smallest (Fine and Wilf); so one of its first ``s`` positions is
synchronising. Its context recurs ``q`` words later, still inside, and not earlier,
by the same theorem. What is found is compared word by word, so nothing wrong is
reported; contexts are told apart by hashes of 64 bits.

A word is dropped when a run has it behind that run's first ``q`` words.

Defined cases: a NULL, empty or blank text has no words and no runs. Words are
compared as bytes. Rows with NULL or repeated identifiers are rows like any other.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.runtime import ship

LEAST_REPEATS = 4
LEAST_WORDS = 6

# Periods below this are found by comparison, the others from synchronising positions.
_FIRST_SCALE = 4
# Documents are worked on together up to so many words or bytes; a longer one by itself.
_WORDS, _BYTES = 1 << 18, 1 << 24
# Texts are split into words by blocks of so many bytes, and compared by so many places at once.
_BLOCK, _PLACES = 1 << 20, 1 << 22

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

# Start of the part to rewrite and its period, or None to leave the words as they are.
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit numbers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _first_hashes(words: np.ndarray) -> np.ndarray:
    return _mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _doubled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of stretches twice as wide (of no meaning where the text ends before)."""
    longer = hashes * np.uint64(0x9E3779B97F4A7C15)
    longer[: len(hashes) - width] += hashes[width:]
    return _mixed(longer)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of True begin and end."""
    steps = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
    return steps[::2], steps[1::2]


class _Texts:
    """Word numbers of documents laid end to end, with what is left of its document at each word."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, names: np.ndarray):
        self.words, self.lengths, self.names = words, lengths, names
        self.begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.document = np.repeat(np.arange(len(lengths)), lengths)
        self.left = self.begins[self.document] + lengths[self.document] - np.arange(len(words))

    def without_short(self, least: int, *more: np.ndarray) -> tuple:
        """Documents of ``least`` words or more, and what ``more`` has of them."""
        keep = self.lengths >= least
        if keep.all():
            return self, *more
        chosen = keep[self.document]
        return _Texts(self.words[chosen], self.lengths[keep], self.names[keep]), *(array[chosen] for array in more)


def _small_periods(texts: _Texts, period: int) -> np.ndarray:
    words = texts.words
    if len(words) <= period:
        return np.empty((0, 4), np.int64)
    same = (words[period:] == words[:-period]) & (texts.left[:-period] > period)
    start, end = _stretches(same)
    long = end - start + period >= LEAST_REPEATS * period
    start, end = start[long], end[long]
    if period > 1:
        # 2 and 3 have no other divisor than 1
        several = words[start] != words[start + 1]
        if period == 3:
            several |= words[start] != words[start + 2]
        start, end = start[several], end[several]
    return _rows(texts, start, end - start + period, np.full(len(start), period))


def _rows(texts: _Texts, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    document = texts.document[start]
    return np.column_stack((texts.names[document], start - texts.begins[document], length, period))


def _periodic(texts: _Texts, runs: np.ndarray, scale: int) -> np.ndarray:
    """Positions whose stretch of ``scale`` words has a period of a quarter of that or less."""
    place = np.full(int(texts.names.max(initial=-1)) + 1, -1)
    place[texts.names] = np.arange(len(texts.names))
    runs = runs[(runs[:, 3] * 4 <= scale) & (runs[:, 2] >= scale)]
    runs = runs[runs[:, 0] < len(place)]
    at = place[runs[:, 0]]
    runs, at = runs[at >= 0], at[at >= 0]
    change = np.zeros(len(texts.words) + 1, np.int32)
    first = texts.begins[at] + runs[:, 1]
    np.add.at(change, first, 1)
    np.add.at(change, first + runs[:, 2] - scale + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _synchronising(texts: _Texts, hashes: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    hashes = np.where(periodic, _NONE, hashes)
    least, width = hashes, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    # least has the minimum over ``scale`` positions; one more belongs to the window
    count = len(hashes) - scale
    least = np.minimum(least[:count], hashes[scale:])
    chosen = (hashes[:count] == least) | (hashes[scale:] == least)
    chosen &= (least != _NONE) & (texts.left[:count] >= 2 * scale)
    return np.flatnonzero(chosen)


def _proposals(chosen: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances to the next equal context, of distances from ``scale`` to ``2 * scale - 1``."""
    context = contexts[chosen]
    order = np.argsort(context, kind="stable")
    context, at = context[order], chosen[order]
    distance = at[1:] - at[:-1]
    fits = (context[1:] == context[:-1]) & (distance >= scale) & (distance < 2 * scale)
    return at[:-1][fits], distance[fits]


def _extended(texts: _Texts, at: np.ndarray, period: np.ndarray, scale: int) -> np.ndarray:
    """Runs around the proposals. Those of one run are at most a period apart, so each run is looked at once."""
    if not len(at):
        return np.empty((0, 4), np.int64)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.concatenate(([True], (period[1:] != period[:-1]) | (at[1:] - at[:-1] > period[1:])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    core, core_end, period = at[first], at[last] + 2 * scale, period[first]
    document = texts.document[core]
    begin = texts.begins[document]
    # Beyond a period on either side there would have been another proposal.
    low = np.maximum(core - period, begin)
    high = np.minimum(core_end + period, begin + texts.lengths[document] - period)
    found = []
    ends = np.cumsum(high - low)
    group = 0
    while group < len(low):
        done = ends[group - 1] if group else 0
        stop = max(group + 1, int(np.searchsorted(ends, done + _PLACES, "right")))
        found.append(_compared(texts, low[group:stop], high[group:stop], core[group:stop], core_end[group:stop], period[group:stop]))
        group = stop
    return np.concatenate(found)


def _compared(texts: _Texts, low, high, core, core_end, period) -> np.ndarray:
    count = high - low
    offset = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(len(low)), count)
    place = np.arange(offset[-1]) - (offset[:-1] - low)[owner]
    same = texts.words[place] == texts.words[place + period[owner]]
    # The last place that differs before the core, the first that differs behind its beginning.
    inside = np.arange(offset[-1])
    differs_before = np.where(~same & (place < core[owner]), inside, offset[:-1][owner] - 1)
    differs_after = np.where(~same & (place >= core[owner]), inside, offset[1:][owner])
    start = np.maximum.reduceat(differs_before, offset[:-1]) + 1
    end = np.minimum.reduceat(differs_after, offset[:-1])
    length = end - start + period
    start += low - offset[:-1]
    right = (start + length - period >= core_end) & (length >= LEAST_REPEATS * period)
    return _rows(texts, start[right], length[right], period[right])


def find_runs(documents: Sequence[np.ndarray], least_words: int = LEAST_WORDS) -> np.ndarray:
    """Rows ``document, start, length, period`` of all runs, in that order (start before period)."""
    lengths = np.array([len(words) for words in documents], np.int64)
    words = np.concatenate([*documents, np.empty(0, np.int64)])
    texts = _Texts(words.astype(np.int64), lengths, np.arange(len(documents)))
    (texts,) = texts.without_short(LEAST_REPEATS)
    runs = np.concatenate([_small_periods(texts, period) for period in range(1, _FIRST_SCALE)])
    hashes, width, scale = _first_hashes(texts.words), 1, _FIRST_SCALE
    while len(texts.words):
        texts, hashes = texts.without_short(LEAST_REPEATS * scale, hashes)
        if not len(texts.words):
            break
        while width < scale:
            hashes, width = _doubled(hashes, width), 2 * width
        contexts = _doubled(hashes, width)
        chosen = _synchronising(texts, hashes, _periodic(texts, runs, scale), scale)
        runs = np.concatenate((runs, _extended(texts, *_proposals(chosen, contexts, scale), scale)))
        hashes, width, scale = contexts, 2 * width, 2 * scale
    runs = np.unique(runs[runs[:, 2] >= least_words], axis=0) if len(runs) else runs
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def kept_words(count: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``count`` words no run has behind its first period."""
    change = np.zeros(count + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def _numbered(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The words of ``text`` as numbers; new words are added to ``known``."""
    parts, at = [], 0
    while at < len(text):
        found = _SPACE.search(text, at + _BLOCK)
        end = found.end() if found else len(text)
        parts.append(np.array([known.setdefault(word, len(known)) for word in text[at:end].split()], np.int64))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _rewritten(words: np.ndarray, identifier: int | None, rewrite: Rewrite | None) -> np.ndarray:
    found = rewrite(identifier, len(words)) if rewrite else None
    if found is None:
        return words
    start, period = found
    words[start:] = words[start + np.arange(len(words) - start) % period]
    return words


def checksum_rewrite(identifier: int | None, count: int) -> tuple[int, int] | None:
    """Rewrites one document in ten, by the CRC-32 of its identifier; those without identifier stay as they are."""
    checksum = 1 if identifier is None else zlib.crc32(str(identifier).encode())
    if checksum % 10 or not count:
        return None
    draw = checksum // 10
    start = draw % count
    return start, 1 + (count - start) // (3 + draw % 8)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


class _Chunk:
    """Documents that are worked on together."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.identifiers: list[int | None] = []
        self.documents: list[np.ndarray] = []
        self.words = self.bytes = 0

    def add(self, identifier: int | None, text: bytes, rewrite: Rewrite | None) -> None:
        words = _rewritten(_numbered(text, self.known), identifier, rewrite)
        self.identifiers.append(identifier)
        self.documents.append(words)
        self.words += len(words)
        self.bytes += len(text)

    def full(self) -> bool:
        return self.words >= _WORDS or self.bytes >= _BYTES

    def batch(self) -> pa.RecordBatch:
        runs = find_runs(self.documents)
        borders = np.searchsorted(runs[:, 0], np.arange(len(self.documents) + 1)).astype(np.int32)
        spelled = list(self.known)
        collapsed = []
        for number, words in enumerate(self.documents):
            own = runs[borders[number] : borders[number + 1]]
            if len(own):
                words = words[kept_words(len(words), own)]
            collapsed.append(b" ".join([spelled[word] for word in words.tolist()]))
        fields = [pa.array(runs[:, column], pa.int64()) for column in (1, 2, 3)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.identifiers, pa.int64()),
                pa.array([len(words) for words in self.documents], pa.int64()),
                pa.ListArray.from_arrays(pa.array(borders), pa.StructArray.from_arrays(fields, fields=list(_RUN))),
                pa.array(collapsed, pa.binary()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def _run_batches(rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in batches:
            for identifier, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.add(identifier, text.as_py() or b"", rewrite)
                if chunk.full():
                    yield chunk.batch()
                    chunk = _Chunk()
        if chunk.documents:
            yield chunk.batch()

    return run


def periodic_runs(
    docs: DataFrame, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs``; ``collapsed`` is the text without dropped words.

    ``rewrite(identifier, n)`` may name a place and a period: from there on the words
    are repeated with that period before runs are looked for. No row meets another,
    so there is nothing to shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(_run_batches(rewrite), _SCHEMA)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def _strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first."""
    ahead = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.reduce(runs, F.get(runs, 0), lambda best, run: F.when(ahead(best, run), run).otherwise(best))


def run_digests(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """Number of runs, the strongest one and digests of all runs and of the collapsed text, per row of ``docs``."""
    found = periodic_runs(docs, rewrite).withColumn("best", _strongest(F.col("runs")))
    line = lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
