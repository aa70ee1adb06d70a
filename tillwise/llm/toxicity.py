"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes.

A text's features are the character n-grams that occur in it, hashed into
``BUCKETS``. A feature's value is its naive Bayes log-count ratio (how much more
often toxic texts have it), and the vector is scaled to length one. A linear
support vector machine is fitted on these by dual coordinate descent; its
margins, from folds that were not fitted on, give the two constants of a
logistic curve that turns a margin into a score from 0 to 1.

The classifier is fitted on the driver, on a bounded sample (:class:`Bounds`): at
most ``toxic_rows`` and ``clean_rows`` labelled documents, in order of a hash of the
identifier, of texts up to ``text_bytes``. A sampled document counts for as many
as there are labels of its kind for each one sampled, so the bounds do not change
how often the model takes texts to be toxic. Labels whose ``crc32(identifier as
text) mod 3`` is 1 are held out and never read. Scores look at the text alone, and
at all of it.

Defined cases: a NULL or empty text has no features; its score comes from the
intercept. A NULL identifier counts as not held out, and its label is not used.
Of contradicting labels of an identifier, toxic counts; of several texts, the
smallest is fitted on. Without labels of both kinds every score is the share of
toxic labels (0 if there are none). An empty table gives an empty result. Other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.runtime import ship

THRESHOLD = 0.7


class Bounds(NamedTuple):
    """What the classifier is fitted on at most."""

    toxic_rows: int = 2000
    clean_rows: int = 4000
    text_bytes: int = 1 << 16


GRAMS = (4, 5, 6)
_BITS = 20
BUCKETS = 1 << _BITS

# A feature has to occur in this many sampled texts.
_LEAST = 3
_COST, _TOXIC_WEIGHT = 10.0, 3.0
_FOLDS, _ROUNDS = 3, 25
# Characters that are hashed in one go.
_GO = 1 << 20


class _Features:
    """Distinct buckets of a text; keeps one array to mark them in."""

    def __init__(self):
        self._marked = np.zeros(BUCKETS, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        plain = " ".join(text.lower().split()) if text else ""
        if not plain:
            return np.zeros(0, np.int32)
        letters = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for start in range(0, len(letters), _GO):
            self._mark(letters[start : start + _GO + GRAMS[-1] - 1])
        found = np.flatnonzero(self._marked)
        self._marked[found] = False
        return found.astype(np.int32)

    def _mark(self, letters: np.ndarray) -> None:
        rolling = np.zeros(len(letters), np.uint32)
        for size in range(1, GRAMS[-1] + 1):
            count = len(letters) - size + 1
            if count <= 0:
                return
            rolling = (rolling[:count] + letters[size - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            rolling ^= rolling >> np.uint32(15)
            if size in GRAMS:
                self._marked[(rolling * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)] = True


def log_count_ratios(features: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Per bucket: log of the share of toxic texts that have it over that of clean ones."""
    counts = np.zeros((2, BUCKETS), np.float32)
    for found, label in zip(features, toxic):
        counts[int(label)][found] += 1
    size = np.array([[np.sum(~toxic)], [np.sum(toxic)]], np.float32)
    share = np.log((counts + 1) / (size + 2))
    return share[1] - share[0]


def _frequent(features: list[np.ndarray]) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int32)
    for found in features:
        counts[found] += 1
    return counts >= _LEAST


class _Vectors:
    """Buckets and values of each text, scaled to length one. Values are made when asked for: kept, they double what the features hold."""

    def __init__(self, features: list[np.ndarray], ratios: np.ndarray):
        self.features, self.ratios = features, ratios
        squares = (ratios[found] @ ratios[found] for found in features)
        self.lengths = [max(np.sqrt(square), np.float32(1e-12)) for square in squares]

    def __len__(self) -> int:
        return len(self.features)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.features[i]
        return found, self.ratios[found] / self.lengths[i]


def _vectors(features: list[np.ndarray], ratios: np.ndarray) -> _Vectors:
    return _Vectors(features, ratios)


def fit_margin(
    vectors: Sequence[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, share: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a squared-hinge support vector machine; ``share``: what each vector counts for."""
    weights, intercept = np.zeros(BUCKETS), 0.0
    sign = np.where(toxic, 1.0, -1.0)
    ridge = 0.5 / (np.where(toxic, _COST * _TOXIC_WEIGHT, _COST) * share)
    dual = np.zeros(len(vectors))
    curvature = np.array([values @ values for _, values in vectors]) + 1.0 + ridge
    order = np.random.default_rng(0)
    for turn in range(_ROUNDS):
        # between rounds over everything, only texts that carry weight are visited
        visited = np.arange(len(vectors)) if turn % 4 == 0 else np.flatnonzero(dual)
        largest = 0.0
        for i in order.permutation(visited):
            found, values = vectors[i]
            slope = sign[i] * (weights[found] @ values + intercept) - 1.0 + ridge[i] * dual[i]
            if dual[i] == 0.0:
                slope = min(slope, 0.0)
            largest = max(largest, abs(slope))
            moved = max(dual[i] - slope / curvature[i], 0.0) - dual[i]
            if moved:
                dual[i] += moved
                weights[found] += moved * sign[i] * values
                intercept += moved * sign[i]
        if turn % 4 == 0 and largest < 0.02:
            break
    return weights, intercept


def fit_curve(margins: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities (Platt's smoothed targets)."""
    positive, negative = float(share[toxic].sum()), float(share[~toxic].sum())
    target = np.where(toxic, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, offset = 1.0, np.log((positive + 1) / (negative + 1))
    for _ in range(100):
        guess = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        wrong, heavy = share * (guess - target), share * guess * (1 - guess) + 1e-9
        a, b, c = (heavy * margins**2).sum() + 1e-6, (heavy * margins).sum(), heavy.sum()
        g, h = (wrong * margins).sum(), wrong.sum()
        det = a * c - b * b
        step = np.array([(c * g - b * h) / det, (a * h - b * g) / det])
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(slope), float(offset)


class ToxicityModel:
    """``ratios`` and ``weights`` per bucket, intercept, slope and offset. ``share``: the score without both kinds of labels."""

    def __init__(self, texts: list[str | None], labels: list[int], counts: tuple[int, int] | None = None):
        """``counts``: clean and toxic labels that the sample stands for (None: itself)."""
        toxic = np.array(labels, bool)
        self.share = None
        if not toxic.any() or toxic.all():
            self.share = float(toxic.mean()) if len(toxic) else 0.0
            return
        sampled = np.array([np.sum(~toxic), np.sum(toxic)], float)
        stands = np.array(sampled if counts is None else counts) / sampled
        # one on the mean: how much the margin gives way to single texts depends on the sample's size alone
        counted = (stands * len(toxic) / (stands * sampled).sum())[toxic.astype(int)]
        features = list(map(_Features(), texts))
        frequent = _frequent(features)
        for i, found in enumerate(features):  # one by one, never all of them twice
            features[i] = found[frequent[found]]
        margins = np.zeros(len(toxic))
        fold = np.arange(len(toxic)) % _FOLDS
        for number in range(_FOLDS):
            fitted = np.flatnonzero(fold != number)
            # ratios without the fold that is set aside: they would give its labels away
            ratios = log_count_ratios([features[i] for i in fitted], toxic[fitted])
            weights, intercept = fit_margin(_vectors([features[i] for i in fitted], ratios), toxic[fitted], counted[fitted])
            for i in np.flatnonzero(fold == number):
                found, values = _vectors([features[i]], ratios)[0]
                margins[i] = weights[found] @ values + intercept
        self.slope, self.offset = fit_curve(margins, toxic, counted)
        ratios = log_count_ratios(features, toxic)
        weights, self.intercept = fit_margin(_vectors(features, ratios), toxic, counted)
        self.ratios = np.where(frequent, ratios, np.float32(0))
        self.weights = (weights * self.ratios).astype(np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        margins, features = np.zeros(len(texts)), _Features()
        for i, text in enumerate(texts):
            found = features(text)
            length = np.sqrt(np.square(self.ratios[found], dtype=np.float64).sum())
            margins[i] = self.weights[found].sum(dtype=np.float64) / max(length, 1e-12) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -700, 700)))


def _remainder(identifier: Column) -> Column:
    return F.crc32(identifier.cast("string").cast("binary")) % 3


def train(
    docs: DataFrame,
    labels: DataFrame,
    bounds: Bounds = Bounds(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Fit on the sample. What is broadcast and collected is bounded by the two row counts and the size of a text."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (_remainder(F.col("doc_id")) != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    ordered = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*ordered).limit(bounds.toxic_rows).union(
        known.filter("toxic = 0").orderBy(*ordered).limit(bounds.clean_rows)
    )
    sample = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(picked), "doc_id")
        .filter(F.octet_length("text") <= bounds.text_bytes)
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    )
    rows = sorted(sample.collect(), key=lambda row: row.doc_id)
    counts = {row.toxic: row["count"] for row in known.groupBy("toxic").count().collect()}
    return ToxicityModel([row.text for row in rows], [row.toxic for row in rows], (counts.get(0, 0), counts.get(1, 0)))


def _scores(model, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.scores(texts.to_pylist()))

    return score(text)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    bounds: Bounds = Bounds(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    context = ship(docs.sparkSession).sparkContext
    model = context.broadcast(train(docs, labels, bounds, id_col, text_col))
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), _scores(model, F.col(text_col)).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(_remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    bounds: Bounds = Bounds(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    context = ship(docs.sparkSession).sparkContext
    model = context.broadcast(train(docs, labels, bounds, id_col, text_col))
    return docs.filter(_scores(model, F.col(text_col)) < threshold)
