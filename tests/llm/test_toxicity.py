from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tillwise.llm import toxicity
from tillwise.llm.toxicity import (
    BUCKETS, GRAMS, Bounds, ToxicityModel, _Features, drop_toxic, fit_curve, fit_margin, log_count_ratios, score_documents,
)


def made_up(dice, toxic):
    words = ["river", "stone", "walk", "green", "paper", "window", "evening", "quiet", "letter", "market"]
    text = [dice.choice(words) for _ in range(dice.randint(5, 60))]
    for _ in range(toxic * dice.randint(1, 4)):
        text.insert(dice.randint(0, len(text)), dice.choice(["scumbag", "moronic", "worthless"]))
    return " ".join(text)


@pytest.fixture(scope="module")
def corpus():
    dice = random.Random(1)
    return [(i, made_up(dice, i % 5 == 0), int(i % 5 == 0)) for i in range(600)]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_features_are_the_distinct_grams():
    features = _Features()
    text = "  Abc abC \n abcdef"
    plain = " abc abc abcdef "
    grams = {plain[i : i + n] for n in GRAMS for i in range(len(plain) - n + 1)}
    found = features(text)
    assert len(found) == len(set(found)) and abs(len(found) - len(grams)) <= 1
    assert (features(text) == found).all() and (features("ABC abc ABCDEF") == found).all()
    assert len(features(None)) == len(features(" \n")) == 0


def test_ratios():
    features = [np.array([1, 2]), np.array([1]), np.array([3])]
    ratios = log_count_ratios(features, np.array([True, True, False]))
    assert np.isclose(ratios[1], np.log(3 / 4) - np.log(1 / 3)) and np.isclose(ratios[3], np.log(1 / 4) - np.log(2 / 3))
    assert len(ratios) == BUCKETS


def test_curve():
    dice = np.random.default_rng(0)
    margins = dice.normal(0, 2, 20_000)
    toxic = dice.random(20_000) < 1 / (1 + np.exp(-(1.5 * margins - 1)))
    slope, offset = fit_curve(margins, toxic, np.ones(len(toxic)))
    assert abs(slope - 1.5) < 0.1 and abs(offset + 1) < 0.1
    # half of one kind, counted twice, gives the same curve
    kept = toxic | (np.arange(len(toxic)) % 2 == 0)
    again = fit_curve(margins[kept], toxic[kept], np.where(toxic[kept], 1.0, 2.0))
    assert abs(again[0] - slope) < 0.1 and abs(again[1] - offset) < 0.1


def noisy(dice, toxic):
    """Texts whose words only lean to one side."""
    mild, rude = ["river", "stone", "walk", "green", "paper"], ["scumbag", "moronic", "worthless", "rotten", "filthy"]
    return " ".join(dice.choice(rude if dice.random() < (0.45 if toxic else 0.15) else mild) for _ in range(12))


def test_bounds_do_not_move_scores(spark, docs_of):
    """Only the bounds change: the sample has another ratio of labels, the scores stay about the same."""
    dice = random.Random(9)
    corpus = [(i, noisy(dice, i % 8 == 0), int(i % 8 == 0)) for i in range(3000)]
    docs = docs_of([(i, t) for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, 1, label) for i, _, label in corpus], "doc_id long, quality int, toxic int")
    scores = {}
    for bounds in (Bounds(), Bounds(toxic_rows=240, clean_rows=480), Bounds(toxic_rows=150, clean_rows=1200)):
        rows = score_documents(docs, labels, bounds=bounds).collect()
        scores[bounds] = np.array([r.score for r in sorted(rows, key=lambda r: r.doc_id)])
    whole, *cut = scores.values()
    for found in cut:
        # a third of the first sample is toxic, and a ninth of the second
        assert np.abs(found.mean() - whole.mean()) < 0.08
        assert np.abs(found - whole).mean() < 0.1
    texts = score_documents(docs, labels, bounds=Bounds(text_bytes=0)).collect()
    assert {r.score for r in texts} == {0.0}


def test_score_by_hand():
    """Two texts, weights put in by hand: ratio, length, margin and curve of the score."""
    model = ToxicityModel(["aaaa bbbb", "aaaa cccc"] * 3, [1, 0] * 3)
    features = _Features()
    found = features("aaaa bbbb dddd")
    ratios, weights = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    ratios[found[0]], ratios[found[1]] = 3.0, 4.0
    weights[found[0]], weights[found[1]] = 2.0, 1.0
    model.ratios, model.weights, model.intercept = ratios, weights * ratios, -0.5
    model.slope, model.offset = 1.5, 0.25
    margin = (2 * 3 + 1 * 4) / 5 - 0.5
    assert model.scores(["aaaa bbbb dddd"])[0] == pytest.approx(1 / (1 + np.exp(-(1.5 * margin + 0.25))))
    assert model.scores([None])[0] == pytest.approx(1 / (1 + np.exp(-(1.5 * -0.5 + 0.25))))


def test_margin_is_the_best(corpus):
    """No small step away from the fitted weights lowers what they minimise."""
    dice = np.random.default_rng(1)
    features = list(map(_Features(), [t for _, t, _ in corpus[:80]]))
    toxic = np.array([label for _, _, label in corpus[:80]], bool)
    vectors = toxicity._vectors(features, log_count_ratios(features, toxic))
    share = np.where(toxic, 0.5, 1.2)
    weights, intercept = fit_margin(vectors, toxic, share)
    cost = np.where(toxic, toxicity._COST * toxicity._TOXIC_WEIGHT, toxicity._COST) * share
    sign = np.where(toxic, 1, -1)

    def loss(w, b):
        margins = np.array([w[found] @ values + b for found, values in vectors])
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * margins) ** 2).sum()

    used = np.unique(np.concatenate(features))
    best = loss(weights, intercept)
    for size in (0.3, 0.03):
        for _ in range(30):
            step = np.zeros(BUCKETS)
            step[used] = dice.normal(0, size / np.sqrt(len(used)), len(used))
            assert loss(weights + step, intercept + dice.normal(0, size)) > best - 1e-3 * best


def test_held_out_accuracy_and_drop(spark, docs_of, corpus):
    docs = docs_of([(i, t) for i, t, _ in corpus] + [(1000, None), (1001, ""), (None, "you moronic scumbag"), (5, corpus[5][1])], True)
    # Wrong labels where they are held out: they must not be read.
    rows = [(i, 1, 1 - label if held(i) else label) for i, _, label in corpus] + [(None, 1, 1), (7, None, None), (2000, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = score_documents(docs, labels).collect()
    assert len(found) == len(corpus) + 4
    truth = {i: label for i, _, label in corpus}
    for row in found:
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
        assert row.held_out == (row.doc_id is not None and held(row.doc_id))
    judged = [r for r in found if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in judged) / len(judged) > 0.97
    kept = drop_toxic(docs, labels)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.predicted == 0 for r in found)


def test_without_both_kinds_of_labels(spark, docs_of):
    docs = docs_of([(1, "a text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in score_documents(docs, none).collect()] == [0.0, 0.0]
    assert drop_toxic(docs, none).count() == 2
    assert ToxicityModel(["a", "b"], [1, 1]).scores(["c"]).tolist() == [1.0]
    assert score_documents(docs.limit(0), none).count() == 0


def test_fitting_holds_the_features_once():
    """No second copy of the features while rare ones are dropped, and none of the vectors' values."""
    dice = np.random.default_rng(5)
    texts = ["".join(map(chr, dice.integers(97, 123, 60_000))) for _ in range(100)]
    features = sum(found.nbytes for found in map(_Features(), texts))
    tracemalloc.start()
    ToxicityModel(texts, [int(i % 5 == 0) for i in range(len(texts))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert features > 40e6 and peak < 1.3 * features + 40e6
