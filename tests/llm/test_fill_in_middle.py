from __future__ import annotations

import hashlib
import random
import re

import pytest

from tillwise.llm import fill_in_middle as fim
from tillwise.llm.fill_in_middle import Rule, Tokens, fill_in_middle, restore, restored, rotate, transform, transformation_digests

PARTS = ["word", "A", " ", "\n", "é", "中", "😀", "<", "P>", "<S", ">", "M", "1", "́", "\r\n", "x" * 30]


def expected(identifier, text):
    """``n, form, prefix, middle, suffix, output`` by the definition."""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    hexed = hashlib.sha256(f"1:{'' if identifier is None else identifier}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rotation_in_place(monkeypatch):
    dice = random.Random(3)
    for block in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(fim, "BLOCK", block)
        for _ in range(200):
            data = bytes(dice.randrange(256) for _ in range(dice.randint(0, 40)))
            start, cut, end = sorted(dice.randint(0, len(data)) for _ in range(3))
            buffer = bytearray(data)
            rotate(buffer, start, cut, end)
            assert buffer == data[:start] + data[cut:end] + data[start:cut] + data[end:]


@pytest.mark.parametrize("block", [1, 3, 16, 1 << 20])
def test_tokens_by_blocks(block):
    dice = random.Random(block)
    for _ in range(150):
        text = "".join(dice.choice(PARTS) for _ in range(dice.randint(0, 30)))
        tokens, found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), Tokens(text.encode(), block)
        assert found.n == len(tokens)
        for number in range(len(tokens) + 1):
            before = "".join(tokens[:number])
            assert found.place(number) == len(before.encode())
            assert found.characters(0, found.place(number)) == len(before)


def test_every_form_against_definition_and_back():
    dice = random.Random(11)
    seen = set()
    for identifier in range(-50, 900):
        text = "".join(dice.choice(PARTS) for _ in range(dice.randint(0, 25)))
        made = transform(text.encode(), identifier)
        assert (made.n, made.form, made.prefix_chars, made.middle_chars, made.output.decode()) == expected(identifier, text)
        assert restore(bytes(made.output), made.form).decode() == text
        seen.add(made.form)
    assert seen == {"plain", "psm", "spm"}


def test_other_rules_go_back_too():
    rule = Rule(seed="x", plain=0, spm=50, prefix=b"[pre]", suffix=b"[s]", middle=b"[mid]")
    forms = set()
    for identifier in range(60):
        text = f"def f{identifier}(x):\n    return x + {identifier}\n".encode()
        made = transform(text, identifier, rule)
        forms.add(made.form)
        assert bytes(made.output) != text and restore(bytes(made.output), made.form, rule) == text
    assert forms == {"psm", "spm"}


def test_odd_documents(docs_of, odd_pairs):
    dice = random.Random(2)
    pairs = [*odd_pairs, (500, "lé <P> x"), (501, "a\x00b"), (502, "word " * 600_000), (503, "z" * 3_000_000)]
    pairs += [(600 + k, "".join(dice.choice(PARTS) for _ in range(20))) for k in range(60)]
    docs = docs_of(pairs, clashing=True)
    made = fill_in_middle(docs)
    rows = made.withColumn("back", restored(made["output"], made["form"])).collect()
    digests = transformation_digests(docs).collect()
    assert len(rows) == len(digests) == len(pairs)
    for (identifier, text), row, digest in zip(pairs, rows, digests):
        text = text or ""
        n, form, prefix, middle, output = expected(identifier, text)
        assert (row.doc_id, row.n, row.form, row.prefix_chars, row.middle_chars) == (identifier, n, form, prefix, middle)
        assert row.output == output and row.back == text
        assert digest.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert digest.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty(docs_of):
    assert transformation_digests(docs_of([])).count() == 0
