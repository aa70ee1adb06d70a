from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tillwise.llm import periodic_runs as pr
from tillwise.llm.periodic_runs import checksum_rewrite, find_runs, kept_words, periodic_runs, run_digests


def brute(words, least=6):
    """Every period compared everywhere."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            start = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            length = x - start + q
            if x > start and length >= max(least, 4 * q):
                smaller = (all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q) if q % d == 0)
                if not any(smaller):
                    found.append((start, length, q))
            x += x == start
    return sorted(found, key=lambda run: (run[0], run[2]))


def some_words(dice, n, letters):
    words = [dice.randrange(letters) for _ in range(n)]
    for _ in range(dice.randint(0, 4)):
        period, start = dice.randint(1, max(1, n // 5)), dice.randint(0, n - 1)
        base = [dice.randrange(letters) for _ in range(period)]
        if dice.random() < 0.4 and period > 4:
            # a period that is itself nearly periodic
            q = dice.randint(1, period // 3 + 1)
            base = [base[k % q] for k in range(period - 1)] + [base[-1]]
        for k in range(start, dice.randint(start, n)):
            words[k] = base[(k - start) % period]
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 60])
def test_against_brute_force(letters):
    dice = random.Random(letters)
    for _ in range(25):
        documents = [some_words(dice, dice.randint(1, 260), letters) for _ in range(8)] + [[]]
        found = find_runs([np.array(words, np.int64) for words in documents])
        for number, words in enumerate(documents):
            assert [tuple(run[1:]) for run in found[found[:, 0] == number].tolist()] == brute(words)


def test_every_short_binary_text():
    documents = [[number >> k & 1 for k in range(n)] for n in range(1, 12) for number in range(1 << n)]
    found = find_runs([np.array(words, np.int64) for words in documents])
    by_document = {}
    for document, *run in found.tolist():
        by_document.setdefault(document, []).append(tuple(run))
    for number, words in enumerate(documents):
        assert by_document.get(number, []) == brute(words)


@pytest.mark.parametrize("period", [*range(1, 70), 127, 128, 129, 500])
def test_every_period_at_its_least_length(period):
    dice = np.random.default_rng(period)
    for extra in (-1, 0, 1):
        run = np.resize(dice.permutation(period), 4 * period + extra) + 1_000
        words = np.concatenate((np.arange(300), run, 5_000 + np.arange(77)))
        want = [[0, 300, len(run), period]] if len(run) >= max(6, 4 * period) else []
        assert find_runs([words]).tolist() == want


def test_groups_of_places(monkeypatch):
    """Comparing few places at once gives the same."""
    dice = random.Random(8)
    documents = [np.array(some_words(dice, 250, 3), np.int64) for _ in range(20)]
    whole = find_runs(documents).tolist()
    monkeypatch.setattr(pr, "_PLACES", 10)
    assert whole and find_runs(documents).tolist() == whole


def test_colliding_hashes_report_nothing_wrong(monkeypatch):
    monkeypatch.setattr(pr, "_mixed", lambda x: x & np.uint64(7))
    dice = random.Random(12)
    for _ in range(20):
        words = some_words(dice, 200, 4)
        assert {tuple(run[1:]) for run in find_runs([np.array(words, np.int64)]).tolist()} <= set(brute(words))


def test_synchronising_positions_depend_on_their_context():
    """Equal contexts are both chosen or both not; places without small period have a position in reach."""
    dice = random.Random(1)
    words = np.array([w for _ in range(60) for w in (some_words(dice, 80, 2))], np.int64)
    texts = pr._Texts(words, np.array([len(words)]), np.array([0]))
    scale, hashes, width = 8, pr._first_hashes(words), 1
    while width < scale:
        hashes, width = pr._doubled(hashes, width), 2 * width
    runs = np.concatenate([pr._small_periods(texts, p) for p in (1, 2, 3)])
    chosen = set(pr._synchronising(texts, hashes, pr._periodic(texts, runs, scale), scale).tolist())
    kinds = {}
    for at in range(len(words) - 2 * scale + 1):
        assert kinds.setdefault(tuple(words[at : at + 2 * scale]), at in chosen) == (at in chosen)
    for at in range(len(words) - 3 * scale):
        part = words[at : at + 3 * scale - 1]
        small = any((part[p:] == part[:-p]).all() for p in (1, 2))
        assert small or any(k in chosen for k in range(at, at + scale))


def rewritten(identifier, words):
    if identifier is None or not words:
        return words
    h = zlib.crc32(str(identifier).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(identifier, text):
    words = rewritten(identifier, (text or "").encode().split())
    runs = brute(words)
    dropped = {k for start, length, q in runs for k in range(start + q, start + length)}
    best = min(runs, key=lambda run: (-run[1] / run[2], run[0], run[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    collapsed = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    return (
        len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(),
    )


def test_query_against_brute_force(docs_of, odd_pairs):
    dice = random.Random(5)
    vocabulary = ["a", "b", "é", "中", "a\xa0b", "Word"]
    pairs = [(i, t) for i, t in odd_pairs if len(t or "") < 10_000]
    pairs += [(1000 + k, " ".join(vocabulary[w] for w in some_words(dice, dice.randint(1, 150), 6))) for k in range(150)]
    rows = run_digests(docs_of(pairs, clashing=True), checksum_rewrite).collect()
    assert len(rows) == len(pairs)
    for (identifier, text), row in zip(pairs, rows):
        assert (row.doc_id, *tuple(row)[1:]) == (identifier, *expected(identifier, text))


def test_very_long_texts(docs_of, monkeypatch):
    one = "x" * 3_000_000
    period = " ".join(f"w{k}" for k in range(1000))
    pairs = [(1, one), (2, " ".join([period] * 500)), (3, "a " * 300_000), (4, "plain words only"), (5, f"{one} {one} {one} {one} {one} {one}")]
    rows = {r.doc_id: r for r in periodic_runs(docs_of(pairs)).collect()}
    runs = {k: [tuple(run) for run in r.runs] for k, r in rows.items()}
    assert runs == {1: [], 2: [(0, 500_000, 1000)], 3: [(0, 300_000, 1)], 4: [], 5: [(0, 6, 1)]}
    assert rows[2].collapsed == period and rows[3].collapsed == "a" and rows[5].collapsed == one and rows[1].n_words == 1


def test_words_by_blocks(monkeypatch):
    monkeypatch.setattr(pr, "_BLOCK", 3)
    known = {}
    text = " a bb\tccc\x0bdddd a \n eeeeeeee  bb ".encode()
    assert [list(known)[k] for k in pr._numbered(text, known)] == text.split()
    assert pr._numbered(b"", known).tolist() == pr._numbered(b" \n ", known).tolist() == []


def test_dropped_words():
    assert kept_words(8, np.array([[0, 1, 6, 1]])).tolist() == [True, True, False, False, False, False, False, True]


def test_empty(docs_of):
    assert run_digests(docs_of([])).count() == 0
