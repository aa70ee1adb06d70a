from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import Row

from tillwise.llm import decontaminate
from tillwise.llm.decontaminate import SeedIndex, drop_contaminated, find_overlaps, item_classes, masks, needed, tokens_of


@pytest.mark.parametrize("window", range(1, 14))
def test_masks_miss_no_choice_of_substitutions(window):
    allowed = window - needed(window)
    family = masks(window, allowed)
    for spots in itertools.combinations(range(window), allowed):
        assert any(
            all(start + p < window and start + p not in spots for p in mask)
            for mask in family for start in range(window)
        )


def brute(texts, items):
    found = set()
    for d, text in enumerate(texts):
        tokens = tokens_of(text)
        for i, item in enumerate(items):
            wanted = tokens_of(item)
            length = min(13, len(wanted))
            if not wanted:
                continue
            least = -(-8 * length // 10)
            for a in range(len(tokens) - length + 1):
                for b in range(len(wanted) - length + 1):
                    if sum(x == y for x, y in zip(tokens[a : a + length], wanted[b : b + length])) >= least:
                        found.add((d, i, a - b))
    # of an item that has to occur word for word, the first place
    exact = {i for i, item in enumerate(items) if 0 < len(tokens_of(item)) < 5}
    first = {}
    for d, i, a in sorted(found):
        first.setdefault((d, i), a)
    return {(d, i, a) for d, i, a in found if i not in exact or first[d, i] == a}


def made_up(dice, vocabulary, count):
    words = [f"w{i}" for i in range(vocabulary)]
    items = [" ".join(dice.choice(words) for _ in range(dice.randint(0, 25))) for _ in range(count)]
    texts = [None, ""]
    for _ in range(2 * count):
        middle = [w if dice.random() < 0.85 else dice.choice(words) for w in tokens_of(dice.choice(items))]
        texts.append(" ".join([dice.choice(words) for _ in range(8)] + middle + [dice.choice(words) for _ in range(8)]))
    return items, texts


@pytest.mark.parametrize("vocabulary", [3, 10, 60])
@pytest.mark.parametrize("go", [1 << 19, 30])
def test_overlaps(monkeypatch, vocabulary, go):
    monkeypatch.setattr(decontaminate, "_GO", go)
    dice = random.Random(vocabulary)
    for _ in range(8):
        items, texts = made_up(dice, vocabulary, 6)
        numbered = list(enumerate(items))
        index = SeedIndex(numbered)
        own = [i for i, item in numbered if tokens_of(item)]
        found = {(d, own[item], a - b) for d, item, a, _, _, b in index.overlaps(texts)}
        assert found == brute(texts, items)


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_documents(spark, docs_of, monkeypatch, block_bytes):
    """One block, and many: the documents are read for each."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    dice = random.Random(11)
    items, texts = made_up(dice, 40, 6)
    pairs = [*enumerate(texts), (None, items[0] + " " + items[1]), (3, texts[3]), (3, texts[3])]
    benchmark = spark.createDataFrame(
        [*((i, t, "a") for i, t in enumerate(items)), (None, None, "b"), (9, "", "b"), (10, items[0], "b"), (11, "?!", "b")],
        "item_id long, text string, doc_id string",
    )
    docs = docs_of(pairs, clashing=True)
    expected = brute([t for _, t in pairs], items)
    rows = find_overlaps(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.doc_start - r.item_start) for r in rows} == {(pairs[d][0], i, s) for d, i, s in expected}
    assert all(0.7 * r.length <= r.matches <= r.length for r in rows)
    clean = drop_contaminated(docs, benchmark)
    assert clean.schema == docs.schema
    hit = {d for d, _, _ in expected}
    assert sorted(str(r.text) for r in clean.collect()) == sorted(str(t) for d, (_, t) in enumerate(pairs) if d not in hit)


@pytest.mark.parametrize(
    "item, text, found",
    [
        ("the quick brown fox", "The quick, brown fox!", True),
        ("the quick brown fox", "so the quick brown fox jumps", True),
        ("the quick brown fox", "the quick red fox", False),
        ("yes", "well, yes", True),
        ("yes", "yesterday", False),
        ("春眠不觉晓处处闻啼鸟夜来风雨声花落知多少", "他说：春眠不觉晓，处处闻啼鸟，夜来风雨声，花落知多少。", True),
        ("春眠不觉晓处处闻啼鸟夜来风雨声花落知多少", "春眠不觉晓，处处听啼鸟，夜来风雨声，花落知几少。", True),
        ("春眠不觉晓处处闻啼鸟夜来风雨声花落知多少", "床前明月光疑是地上霜举头望明月低头思故乡", False),
        ("สวัสดีครับ", "เขาพูดว่าสวัสดีครับแล้ว", True),
        ("?!", "what?!", False),
    ],
)
def test_short_and_unspaced_items(item, text, found):
    assert bool(list(SeedIndex([(1, item)]).overlaps([None, text, ""]))) == found


def test_short_items_are_found_once_in_a_document():
    index = SeedIndex([(1, "of the"), (2, "the")])
    text = "of the " * 50_000
    assert sorted(found[:3] for found in index.overlaps(["the", text, "of", text])) == [(0, 1, 0), (1, 0, 0), (1, 1, 1), (3, 0, 0), (3, 1, 1)]


def test_classes_of_items(spark, docs_of):
    rows = [(5, "one two three four five six seven"), (3, "one two three four five six seven"), (None, "alone here"), (7, None), (8, "")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    assert sorted(map(str, item_classes(benchmark).collect())) == sorted(
        map(str, [Row(item_id=5, class_id=3), Row(item_id=3, class_id=3), Row(item_id=None, class_id=None), Row(item_id=8, class_id=8)]))
    found = find_overlaps(docs_of([(1, "say one two three four five six seven now"), (2, "alone here")]), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found if r.item_id is not None) == [(1, 3)]
    assert [(r.doc_id, r.length) for r in found if r.item_id is None] == [(2, 2)]


def test_very_long_texts():
    index = SeedIndex([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "x" * 1_000_000)])
    text = "word " * 400_000 + "alpha beta gamma delta epsilon zeta eta theta " + "word " * 1000 + "x" * 1_000_000
    assert sorted(found[1:4] for found in index.overlaps([text])) == [(0, 400_000, 8), (1, 401_008, 1)]


def test_empty(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert find_overlaps(docs_of([]), benchmark).count() == 0
    assert find_overlaps(docs_of([(1, "one two")]), benchmark.limit(0)).count() == 0
    assert drop_contaminated(docs_of([(1, "one two")]), benchmark.limit(0)).count() == 1
