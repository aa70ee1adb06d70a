from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest

from tillwise.llm import edit_counts
from tillwise.llm.edit_counts import PieceCounter, PieceTree, count_edited, edit_trees, keep_trees, packed, private_data, unpacked
from tillwise.llm.lm_scoring import Tokens, load_ranks
from tillwise.llm.runtime import stored

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "'s", "'re", "'", "  ", " ", "\n", "\n\n", "1", "22", "!", "word", " the", "é", "中", "'l", "l", "\t", "\x1c", "\xa0"]


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(Tokens(load_ranks(RANKS), public_tokenizers.PATTERN))


def counter_ranks():
    return load_ranks(RANKS)


def whole(counter, text):
    return len(counter.encode(text))


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_edits_against_encoding_anew(monkeypatch, counter, leaf):
    monkeypatch.setattr(edit_counts, "LEAF", leaf)
    monkeypatch.setattr(edit_counts, "_FULL", 8 * leaf)
    dice = random.Random(leaf)
    made = lambda n: "".join(dice.choice(PARTS) for _ in range(dice.randint(0, n)))
    for _ in range(600):
        text = made(60)
        tree = PieceTree(text, counter)
        for _ in range(4):
            start = dice.randint(0, len(text))
            end = dice.randint(start, min(len(text), start + dice.choice([0, 1, 3, 40])))
            new = made(dice.choice([2, 50]))
            tree.apply(start, end, new)
            text = text[:start] + new + text[end:]
            assert tree.text() == text and tree.n_tokens == whole(counter, text)
            assert [p for pieces, _ in tree.leaves for p in pieces] == counter.split(text)


def test_only_the_neighbourhood_is_counted_again(counter):
    tree = PieceTree("some words here " * 5000, counter)
    tree.apply(40_000, 40_004, "other")
    assert tree.recounted < 8


def test_edits_on_the_original(counter):
    tree = PieceTree("abc def ghi", counter)
    assert tree.apply_all([(8, 11, "X"), (0, 0, "1"), (0, 0, "2"), (0, 3, "A"), (4, 8, "")]) == 5
    assert tree.text() == "12A X"
    with pytest.raises(ValueError):
        tree.apply_all([(0, 3, ""), (2, 4, "")])
    with pytest.raises(ValueError):
        tree.apply(0, 99, "")


def edited(text, edits):
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[end:]
    return text


def test_private_data():
    text = 'mail x.y@mail.example.com from 10.2.3.44, card 4994226020900891 TOKEN = "0123456789abcdef" v1.2.3'
    assert edited(text, private_data(text)) == "mail <mail> from <address>, card <number> <secret> v1.2.3"
    assert private_data(None) == private_data("") == []


def test_documents(docs_of, odd_pairs, counter):
    pairs = [*odd_pairs, (400, 'a b@c.de 1.2.3.4 key: "abcdefgh12" 123456789012')]
    rows = count_edited(docs_of(pairs, True), RANKS, public_tokenizers.PATTERN, private_data).collect()
    expected = Counter()
    for identifier, text in pairs:
        edits, text = private_data(text), text or ""
        expected[identifier, whole(counter, text), len(edits), whole(counter, edited(text, edits))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_edits, r.edited_n_tokens) for r in rows) == expected


def test_a_second_batch_starts_from_kept_trees(spark, docs_of, odd_pairs, counter):
    """Two batches of edits on a written table: only what they touch is encoded, and counts are those of the whole."""
    dice = random.Random(6)
    pairs = [*odd_pairs, (500, "some words here " * 40_000)]
    first = keep_trees(docs_of(pairs, True), RANKS, public_tokenizers.PATTERN)
    trees, texts = stored(first, "trees"), [t or "" for _, t in pairs]
    for _ in range(2):
        edits = {}
        for number, text in enumerate(texts):
            start = dice.randint(0, len(text))
            edits[text] = [(start, min(len(text), start + dice.randint(0, 9)), dice.choice(["", "x", " new words", "'s"]))] if dice.random() < 0.7 else None
        table = spark.createDataFrame(list(edits.items()), f"text string, edits {edit_counts._EDITS}")
        after = stored(edit_trees(trees.join(table, "text"), RANKS, public_tokenizers.PATTERN), "trees")
        rows = after.collect()
        assert len(rows) == len(texts)
        for row in rows:
            assert row.edited_n_tokens == unpacked(row.counts).sum() == whole(counter, row.text)
            assert [len(p) for p in counter.split(row.text)] == unpacked(row.lengths).tolist()
            # of the long text, too, a handful of pieces
            assert row.recounted_pieces <= 12 * row.n_edits
        assert sorted(r.text for r in rows) == sorted(edited(t, edits[t] or []) for t in texts)
        trees, texts = after, [r.text for r in rows]


def test_packing():
    for numbers in ([], [0], [1, 2, 3] * 1000, [4_000_000_000]):
        assert unpacked(packed(numbers)).tolist() == numbers


def test_kept_trees_are_not_split_or_encoded_again(spark, counter, monkeypatch):
    text = "some words here " * 5000
    lengths, counts = list(map(len, counter.split(text))), counter.counts(counter.split(text))
    seen = []
    other = PieceCounter(Tokens(counter_ranks(), public_tokenizers.PATTERN))
    monkeypatch.setattr(other, "split", None)
    monkeypatch.setattr(other, "encode", lambda piece: seen.append(piece) or counter.encode(piece))
    tree = PieceTree.kept(text, lengths, counts, other)
    assert tree.n_tokens == whole(counter, text) and seen == []
    tree.apply(40_000, 40_004, "other")
    assert len(seen) <= 8 and tree.n_tokens == whole(counter, tree.text())
    assert tree.state() == (tree.text(), list(map(len, counter.split(tree.text()))), counter.counts(counter.split(tree.text())))


def test_edits_column(spark, counter):
    rows = [(1, "abc def", [(0, 3, "x y"), (4, 4, "z")]), (2, None, [(0, 0, "new")]), (3, "abc", None), (4, "abc", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,replacement:string>>")
    found = count_edited(docs, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r.edited_n_tokens for r in found] == [whole(counter, t) for t in ("x y zdef", "new", "abc", "abc")]
    assert count_edited(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
