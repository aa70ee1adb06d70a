from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from tillwise.llm.exact_dedup import copy_groups, keep_first_copies, normalised_bytes
from tillwise.llm.patricia import PatriciaTrie


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def groups(pairs):
    found = defaultdict(list)
    for identifier, text in pairs:
        found[plain(text)].append(identifier)
    return found


def test_normalised_bytes():
    for text in ("", " ", "a", " a", "a \t\n", "\x0b\x0cé  b\x1c\xa0 ", None):
        assert normalised_bytes(text and text.encode()) == plain(text).encode()


def test_trie_keeps_values_and_gives_out_what_is_before():
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"ba", b"abcd"]
    trie = PatriciaTrie()
    for key in keys:
        assert trie.find_or_add(key, key) is key
        assert trie.find_or_add(key, None) is key
    assert sorted(trie.values()) == sorted(keys)
    before = list(trie.take_before(b"abd"))
    assert set(before) <= {k for k in keys if k < b"abd"} and b"abc" in before
    assert sorted([*before, *trie.take_all()]) == sorted(keys)
    assert trie.bytes == 0


def check(rows, pairs):
    assert len(rows) == len(pairs)
    expected = groups(pairs)
    by_sha = {hashlib.sha256(text.encode()).hexdigest(): ids for text, ids in expected.items()}
    kept = Counter()
    for row in rows:
        ids = by_sha[row.text_sha256]
        assert row.group_size == len(ids)
        assert row.keep_id == min((i for i in ids if i is not None), default=None)
        kept[row.text_sha256] += row.kept
        assert not row.kept or row.doc_id == row.keep_id
    assert set(kept.values()) <= {1} and len(kept) == len(expected)
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in pairs)


def test_groups(docs_of, odd_pairs):
    check(copy_groups(docs_of(odd_pairs)).collect(), odd_pairs)


def test_groups_with_subtrees_passed_on(docs_of, odd_pairs):
    check(copy_groups(docs_of(odd_pairs * 3), memory=1).collect(), odd_pairs * 3)


def test_kept_rows_are_whole(docs_of, odd_pairs):
    docs = docs_of(odd_pairs, clashing=True)
    kept = keep_first_copies(docs, memory=5_000)
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert sorted(plain(r.text) for r in rows) == sorted(groups(odd_pairs))
    assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    for row in rows:
        ids = [i for i in groups(odd_pairs)[plain(row.text)] if i is not None]
        assert row.doc_id == min(ids, default=None)


def test_empty(docs_of):
    assert copy_groups(docs_of([])).count() == 0
    assert keep_first_copies(docs_of([])).count() == 0
