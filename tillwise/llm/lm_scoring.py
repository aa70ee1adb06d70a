"""Cross-entropy difference of documents under a target and a background language model.

Both models are token bigram models of the same form over the one vocabulary of
a public tokenizer: counts with a Dirichlet prior of ``PRIOR`` tokens from the
unigram model, which adds one to every count. The background is all documents,
the target those whose label says so. A document's score is the mean over its
tokens of target loss less background loss, so low scores look like the target.

Nothing is kept but counts of everything. Texts are tokenized once, into a
stored table with a row per chunk of about ``CHUNK`` tokens. Chunks send their
distinct bigrams to the counting and, once the models stand, to a join with
the losses; the losses come back to the chunk, which sums them over its
documents. So what moves is distinct bigrams of chunks, never tokens of
documents, and no table of bigrams has to fit anywhere. Only tables with one row
per vocabulary entry are broadcast.

Defined cases: a NULL or empty text has no tokens, and losses and score of zero.
A row with a NULL identifier is scored and counts for the background. Rows that
repeat an identifier are scored each; all of them belong to the target if the
identifier does. Without target documents the target model is uniform. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.runtime import ship, stored

PRIOR = 10.0
CHUNK = 1 << 21

# Not a token: what comes before the first one.
_START = 0xFFFF
# Longer texts are encoded in parts of so many characters, cut where the pattern cuts.
_PART = 1 << 16

_encodings: dict[int, tiktoken.Encoding] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Tokens:
    """Broadcast tokenizer; each Python worker builds its encoding once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self._pattern = None

    def encoding(self) -> tiktoken.Encoding:
        if id(self) not in _encodings:
            _encodings[id(self)] = tiktoken.Encoding(
                "ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}
            )
        return _encodings[id(self)]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint16)
        encode = self.encoding().encode_ordinary
        return np.concatenate([np.array(encode(part), np.uint16) for part in self.parts(text)])

    def parts(self, text: str) -> Iterator[str]:
        """``text`` in parts that have the same tokens as the whole.

        Borders are pre-token borders behind something else than white space: of white
        space the pattern leaves the last one to what follows.
        """
        if len(text) <= _PART:
            yield text
            return
        if self._pattern is None:
            self._pattern = regex.compile(self.pattern)
        begin = end = 0
        for found in self._pattern.finditer(text):
            if found.end() - begin > _PART and end > begin:
                yield text[begin:end]
                begin = end
            if not text[found.end() - 1].isspace():
                end = found.end()
        yield text[begin:]

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.ranks, self.pattern = state
        self._pattern = None


_CHUNKS = (
    "chunk long, rows array<long>, ids array<long>, lengths array<int>, before array<int>, tokens binary"
)


def _chunks(tokens, size: int):
    """Pack documents into chunks; a document that is longer than a chunk is continued in the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        chunk = row = base
        held: list[tuple[int, int | None, int, np.ndarray]] = []
        room = size

        def pack() -> pa.RecordBatch:
            rows, ids, before, parts = zip(*held)
            data = zstandard.compress(np.concatenate(parts).astype("<u2").tobytes())
            one = lambda values, kind: pa.array([list(values)], pa.list_(kind))
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk], pa.int64()), "rows": one(rows, pa.int64()), "ids": one(ids, pa.int64()),
                "lengths": one(map(len, parts), pa.int32()), "before": one(before, pa.int32()),
                "tokens": pa.array([data], pa.binary()),
            })

        for batch in batches:
            for identifier, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left, before = tokens.value.encode(text), _START
                while True:
                    part, left = left[:room], left[room:]
                    held.append((row, identifier, before, part))
                    room -= len(part)
                    if room <= 0:
                        yield pack()
                        held, room, chunk = [], size, chunk + 1
                    if not len(left):
                        break
                    before = int(part[-1])
                row += 1
        if held:
            yield pack()

    return run


def _grams(before: list[int], lengths: list[int], packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of a chunk as ``context << 16 | token``, and where each document starts."""
    tokens = np.frombuffer(zstandard.decompress(packed), "<u2").astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    context = np.concatenate([[_START], tokens[:-1]])[: len(tokens)]
    full = np.asarray(lengths) > 0
    context[starts[:-1][full]] = np.asarray(before)[full]
    return context << 16 | tokens, starts


def _count(chunks: pa.Table, targets: pa.Table) -> pa.Table:
    """Distinct bigrams of a chunk with their counts in all and in target documents."""
    if not chunks.num_rows:
        return pa.table({"gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "target": pa.array([], pa.int64())})
    grams, starts = _grams(chunks["before"][0].as_py(), chunks["lengths"][0].as_py(), chunks["tokens"][0].as_py())
    chosen = np.zeros(len(starts) - 1, bool)
    chosen[targets["place"].to_numpy()] = True
    found, where, counts = np.unique(grams, return_inverse=True, return_counts=True)
    target = np.bincount(where[np.repeat(chosen, np.diff(starts))], minlength=len(found)) if len(found) else counts
    return pa.table({"gram": found, "n": counts.astype(np.int64), "target": target.astype(np.int64)})


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, before, lengths, packed in zip(*(column.to_pylist() for column in batch.columns)):
            found = np.unique(_grams(before, lengths, packed)[0])
            yield pa.RecordBatch.from_pydict({"chunk": np.full(len(found), chunk, np.int64), "gram": found})


def _sum(chunks: pa.Table, losses: pa.Table) -> pa.Table:
    """Token count and summed losses of each document (or part of one) in a chunk."""
    if not chunks.num_rows:
        return pa.table({name: pa.array([], kind) for name, kind in _SUMS})
    grams, starts = _grams(chunks["before"][0].as_py(), chunks["lengths"][0].as_py(), chunks["tokens"][0].as_py())
    known = losses["gram"].to_numpy()
    order = np.argsort(known)
    at = order[np.searchsorted(known, grams, sorter=order)] if len(grams) else np.zeros(0, np.int64)
    totals = {}
    for name in ("target_loss", "background_loss"):
        running = np.concatenate([[0.0], np.cumsum(losses[name].to_numpy()[at])])
        totals[name] = running[starts[1:]] - running[starts[:-1]]
    return pa.table({
        "row": pa.array(chunks["rows"][0].as_py(), pa.int64()),
        "doc_id": pa.array(chunks["ids"][0].as_py(), pa.int64()),
        "n_tokens": np.diff(starts),
        **totals,
    })


_SUMS = [
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
    ("target_loss", pa.float64()), ("background_loss", pa.float64()),
]


def _model(counted: DataFrame, vocabulary: int, prior: float) -> DataFrame:
    """``gram, target_loss, background_loss`` of every bigram that occurs."""
    grams = stored(counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("target").alias("target")), "bigrams")
    grams = grams.withColumns({
        "context": F.shiftright("gram", 16), "token": F.col("gram").bitwiseAND(F.lit(0xFFFF).cast("long"))
    })

    def totals(key: str) -> DataFrame:
        """At most one row per vocabulary entry: a bounded broadcast."""
        return F.broadcast(
            grams.groupBy(key).agg(F.sum("n").alias(f"{key}_n"), F.sum("target").alias(f"{key}_target"))
        )

    size = grams.agg(F.sum("n"), F.sum("target")).first()

    def loss(kind: str, total: int):
        single = (F.col(f"token_{kind}") + 1.0) / float((total or 0) + vocabulary)
        return -F.log((F.col(kind) + prior * single) / (F.col(f"context_{kind}") + prior))

    return grams.join(totals("context"), "context").join(totals("token"), "token").select(
        "gram", loss("target", size[1]).alias("target_loss"), loss("n", size[0]).alias("background_loss")
    )


def cross_entropy_difference(
    docs: DataFrame,
    targets: DataFrame,
    ranks_path: str,
    pattern: str,
    prior: float = PRIOR,
    chunk: int = CHUNK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` for every row of ``docs``; losses are means.

    ``targets``: ``doc_id`` of the target documents. ``ranks_path`` is read on the driver.
    """
    ranks = load_ranks(ranks_path)
    if max(ranks.values()) >= _START:
        raise ValueError("token numbers have to fit in 16 bits")
    tokens = ship(docs.sparkSession).sparkContext.broadcast(Tokens(ranks, pattern))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = stored(rows.mapInArrow(_chunks(tokens, chunk), _CHUNKS), "token-chunks")

    chosen = (
        chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id"))
        .join(targets.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select(F.col("chunk").alias("of_chunk"), "place")
    )
    whole = chunks.select("chunk", "before", "lengths", "tokens")
    counted = (
        whole.groupBy("chunk").cogroup(chosen.groupBy("of_chunk"))
        .applyInArrow(_count, "gram long, n long, target long")
    )
    model = _model(counted, len(ranks), prior)
    losses = whole.mapInArrow(_distinct, "chunk long, gram long").join(model, "gram")
    sums = (
        chunks.groupBy("chunk").cogroup(losses.groupBy("chunk"))
        .applyInArrow(_sum, "row long, doc_id long, n_tokens long, target_loss double, background_loss double")
    )
    total = sums.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.sum(name).alias(name) for name in ("n_tokens", "target_loss", "background_loss")),
    )
    mean = lambda name: F.col(name) / F.greatest("n_tokens", F.lit(1))
    return total.select(
        "doc_id", "n_tokens", mean("target_loss").alias("target_loss"), mean("background_loss").alias("background_loss"),
        (mean("target_loss") - mean("background_loss")).alias("score"),
    )
