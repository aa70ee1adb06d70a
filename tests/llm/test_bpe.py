from __future__ import annotations

import hashlib
import pickle
import random
import time

import public_tokenizers
import pytest
import tokenizers

from tillwise.llm import bpe_automaton
from tillwise.llm.bpe_automaton import BpeAutomaton, BpeCodec, encode_documents, encoding_digests

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as file:
        return BpeCodec(file.read())


def test_same_as_library(library, codec, odd_pairs):
    dice = random.Random(2)
    parts = ["a", "aa", "s", "'s", "'re", "'", "!!", "the", "<|endoftext|>", "<|endof", " ", "\n", "\x1c", "\x85", "\xa0",
             "É", "ß", "1", "½", "Σ", "İ", "中", "😀", "́", "ing", "µ", "ª", "ÿ", "Ÿ", "\x00", "가"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 12))) for _ in range(3000)]
    texts += ["".join(dice.choice("aetinosrh") for _ in range(dice.randint(0, 60))) for _ in range(1000)]
    for text in [*texts, *(t or "" for _, t in odd_pairs)]:
        whole = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == whole, text[:200]
        assert codec.decode(whole) == library.decode(whole, skip_special_tokens=False)


def naive(symbols, merges):
    """Merge rules in order, each from left to right."""
    for u, v in merges:
        made, at = [], 0
        while at < len(symbols):
            if symbols[at : at + 2] == [u, v]:
                made.append(u + v)
                at += 2
            else:
                made.append(symbols[at])
                at += 1
        symbols = made
    return symbols


@pytest.mark.parametrize("states", [1 << 18, 3])
def test_gadgets_against_merging(monkeypatch, states):
    """Random merge lists over two letters, where tokens overlap in every way; tables that start anew all the time."""
    monkeypatch.setattr(bpe_automaton, "_STATES", states)
    dice = random.Random(6)
    codes = BpeAutomaton.__init__.__globals__["byte_symbols"]()
    for _ in range(60):
        tokens, merges = ["a", "b", "a.", "b."], []
        while len(merges) < 12:
            u, v = dice.choice(tokens), dice.choice(tokens)
            if u.endswith(".") or u + v in tokens:
                continue
            merges.append((u, v))
            tokens.append(u + v)
        names = [*codes, *(c + "." for c in codes)]
        vocabulary = {name: number for number, name in enumerate(dict.fromkeys([*names, *tokens]))}
        automaton = BpeAutomaton(vocabulary, merges, ".")
        for _ in range(60):
            word = "".join(dice.choice("ab") for _ in range(dice.randint(1, 14)))
            found = [automaton.labels[t] for t in automaton.encode_word(word.encode())]
            assert found == naive([*word[:-1], word[-1] + "."], merges), (merges, word)


def test_a_word_takes_time_in_proportion(codec, library):
    """Letters without white space, to a megabyte; the library does not see a difference."""
    dice = random.Random(4)
    word = "".join(dice.choices("aetinosrhdl", k=1_000_000))
    seconds = {}
    for size in (50_000, 1_000_000):
        begin = time.perf_counter()
        found = codec.automaton.encode_word(word[:size].encode())
        seconds[size] = time.perf_counter() - begin
        assert b"".join(codec.automaton.labels[t].removesuffix("</w>").encode() for t in found) == word[:size].encode()
    assert seconds[1_000_000] < 60 * max(seconds[50_000], 0.02)
    assert codec.encode(word[:100_000]) == library.encode(word[:100_000], add_special_tokens=False).ids


def test_the_table_stays_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "_STATES", 1000)
    dice = random.Random(5)
    word = "".join(dice.choices("aetinosrhdlmc", k=200_000)).encode()
    found = codec.automaton.encode_word(word)
    assert len(codec.automaton.nodes) <= 1001 and len(codec.automaton.moves) <= 1001 * 13
    copy = pickle.loads(pickle.dumps(codec.automaton))
    assert len(copy.nodes) == 1 and copy.encode_word(word) == found


def test_every_beginning_of_a_word_has_its_arc(codec):
    """What is noted on the way is the last token of each beginning's own encoding, as no word end is in it."""
    word = b"internationalisation"
    automaton = codec.automaton
    for end in range(1, len(word)):
        whole = automaton.encode_word(word[:end] + b"\x00")[:-1]
        assert sum(automaton.length[t] for t in whole) == end
        for u, v in zip(whole, whole[1:]):
            assert automaton.step(u, v)


def test_documents(docs_of, odd_pairs, library):
    odd_pairs = [*odd_pairs, (900, "ab" * 1_000_000), (901, "two words " * 200_000)]
    rows = encoding_digests(docs_of(odd_pairs, clashing=True), PATH).collect()
    whole = encode_documents(docs_of(odd_pairs), PATH).collect()
    assert len(rows) == len(whole) == len(odd_pairs)
    for (identifier, text), row, full in zip(odd_pairs, rows, whole):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(row) == (identifier, len(ids), digest(" ".join(map(str, ids))), digest(decoded))
        assert (full.doc_id, full.ids, full.decoded) == (identifier, ids, decoded)


def test_empty(docs_of):
    assert encoding_digests(docs_of([]), PATH).count() == 0
