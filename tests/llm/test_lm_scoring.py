from __future__ import annotations

import math
import random
from collections import Counter

import public_tokenizers
import pytest

from tillwise.llm import lm_scoring
from tillwise.llm.lm_scoring import PRIOR, Tokens, cross_entropy_difference, load_ranks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokens():
    return Tokens(load_ranks(RANKS), public_tokenizers.PATTERN)


def brute(lists, chosen, vocabulary):
    def model(which):
        pairs, contexts, singles = Counter(), Counter(), Counter()
        for found in which:
            for before, token in zip([None, *found], found):
                pairs[before, token] += 1
                contexts[before] += 1
                singles[token] += 1
        size = sum(singles.values())
        return lambda b, t: -math.log(
            (pairs[b, t] + PRIOR * (singles[t] + 1) / (size + vocabulary)) / (contexts[b] + PRIOR)
        )

    models = model([x for x, c in zip(lists, chosen) if c]), model(lists)
    for found in lists:
        sums = [sum(m(b, t) for b, t in zip([None, *found], found)) / max(1, len(found)) for m in models]
        yield len(found), *sums, sums[0] - sums[1]


@pytest.mark.parametrize("chunk", [1 << 22, 37])
def test_against_counting(spark, docs_of, odd_pairs, tokens, chunk):
    """Small chunks continue documents in the next chunk."""
    pairs = [p for p in odd_pairs if p[1] is None or len(p[1]) < 10_000]
    targets = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(2,), (None,), (999,), (301,)], "doc_id long")
    chosen = [i is not None and (i < 60 and i % 2 == 0 or i == 301) for i, _ in pairs]
    rows = cross_entropy_difference(docs_of(pairs, True), targets, RANKS, public_tokenizers.PATTERN, chunk=chunk).collect()
    lists = [tokens.encode(t).tolist() for _, t in pairs]
    expected = sorted((str(i), *found) for (i, _), found in zip(pairs, brute(lists, chosen, len(tokens.ranks))))
    found = sorted((str(r.doc_id), *tuple(r)[1:]) for r in rows)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_parts_have_the_tokens_of_the_whole(tokens, monkeypatch):
    """Parts of any size, down to single pre-tokens, and texts that look ahead at every border."""
    dice = random.Random(3)
    pieces = ["a", "'s", "'re", "'", "  ", " ", "\n", "\n\n", "1", "22", "!", "word", " the", "é", "中", "'l", "\t", "\xa0", "   x"]
    whole = tokens.encoding().encode_ordinary
    for _ in range(400):
        text = "".join(dice.choice(pieces) for _ in range(dice.randint(0, 60)))
        monkeypatch.setattr(lm_scoring, "_PART", dice.choice([1, 2, 5, 10]))
        assert list(tokens.encode(text)) == whole(text)
        assert "".join(tokens.parts(text)) == text
    assert tokens.encode(None).tolist() == []


def test_a_million_characters(tokens):
    dice = random.Random(8)
    text = " ".join("".join(dice.choices("aeioutrnsdl'.,\n 1", k=dice.randint(1, 14))) for _ in range(130_000))
    assert len(text) > 1_000_000 and len(list(tokens.parts(text))) > 10
    assert tokens.encode(text).tolist() == tokens.encoding().encode_ordinary(text)
    one = "x" * 300_000
    assert list(tokens.parts(one)) == [one]


def test_without_targets_and_empty(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long")
    rows = cross_entropy_difference(docs_of([(1, "some text"), (2, "")]), none, RANKS, public_tokenizers.PATTERN).collect()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].target_loss == pytest.approx(math.log(50256)) and by_id[2].score == 0
    assert cross_entropy_difference(docs_of([]), none, RANKS, public_tokenizers.PATTERN).count() == 0
