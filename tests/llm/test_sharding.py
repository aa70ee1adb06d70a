from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tillwise.llm.sharding import Cell, Cells, minimax_cuts, shard_documents


def fits(sizes, capacity, shards):
    used, filled = 1, 0
    for size in sizes:
        if size > capacity:
            return False
        if filled + size > capacity:
            used, filled = used + 1, 0
        filled += size
    return used <= shards


def best(sizes, shards):
    capacity = max([-(-sum(sizes) // shards), *sizes])
    while not fits(sizes, capacity, shards):
        capacity += 1
    return capacity


def test_bounds_enclose_the_optimum():
    dice = random.Random(1)
    for _ in range(50):
        sizes = [[dice.randint(1, 50) for _ in range(dice.randint(1, 4))] for _ in range(12)]
        cells = Cells([Cell(f"{i:04x}", sum(s), len(s)) for i, s in enumerate(sizes)])
        real = best([x for s in sizes for x in s], 5)
        assert cells.smallest(5, True) <= real <= cells.smallest(5, False)


@pytest.mark.parametrize("shards", [2, 7, 40])
def test_cuts_are_optimal(spark, shards):
    dice = random.Random(shards)
    # crowded prefixes, so that cells have to be asked for again
    rows = [(f"{dice.choice('01')}00{dice.choice('0f')}" + f"{dice.getrandbits(240):060x}", dice.choice([17, 900, dice.randint(16, 60)])) for _ in range(900)]
    groups = spark.createDataFrame(rows, "sha string, bytes long")
    starts, capacity = minimax_cuts(groups, shards)
    ordered = sorted(rows)
    assert capacity == best([size for _, size in ordered], shards)
    filled = defaultdict(int)
    for sha, size in ordered:
        filled[sum(sha >= start for start in starts)] += size
    assert max(filled.values()) == capacity and len(filled) <= shards


def test_balanced_cuts_stay_within_the_capacity():
    dice = random.Random(3)
    for _ in range(300):
        sizes = [dice.choice([1, 5, dice.randint(1, 60)]) for _ in range(dice.randint(1, 60))]
        shards = dice.randint(1, 12)
        cells = Cells([Cell(f"{i:04x}", size, 1) for i, size in enumerate(sizes)])
        capacity = cells.smallest(shards, False)
        cuts = [0, *cells.balanced(capacity, shards), cells.total]
        filled = [b - a for a, b in zip(cuts, cuts[1:])]
        assert len(filled) == shards and min(filled) >= 0 and max(filled) <= capacity
        assert set(cuts) <= set(cells.edges)


def test_no_shard_is_left_the_rest(spark):
    dice = random.Random(5)
    rows = [(f"{dice.getrandbits(256):064x}", dice.choice([100, 200, 900, 5000])) for _ in range(4000)]
    starts, capacity = minimax_cuts(spark.createDataFrame(rows, "sha string, bytes long"), 40)
    filled = defaultdict(int)
    for sha, size in rows:
        filled[sum(sha >= start for start in starts)] += size
    mean = sum(size for _, size in rows) / 40
    assert len(filled) == 40 and max(filled.values()) <= capacity and min(filled.values()) > 0.8 * mean


def test_rows_that_repeat_their_identifier_are_spread(docs_of):
    pairs = [(None, "same")] * 3000 + [(7, "other")] * 50
    check(shard_documents(docs_of(pairs), 3).collect(), pairs, 3)


def check(rows, pairs, shards):
    assert len(rows) == len(pairs)
    shard_of, slots = {}, defaultdict(list)
    want = defaultdict(int)
    for identifier, text in pairs:
        data = (text or "").encode()
        want[identifier, len(data) + 16, zlib.crc32(data)] += 1
    for row in rows:
        want[row.doc_id, row["size"], row.text_crc32] -= 1
        assert 0 <= row.shard < shards and row.law == "bytes" and row.grown_shard is None
        slots[row.shard].append(row.slot)
        assert shard_of.setdefault((row.text_crc32, row["size"]), row.shard) == row.shard
    assert not any(want.values())
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_odd_documents(docs_of, odd_pairs):
    check(shard_documents(docs_of(odd_pairs, clashing=True)).collect(), odd_pairs, 40)


def test_hot_text_gets_a_shard_of_its_own(docs_of):
    pairs = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * 4) for i in range(600)]
    rows = shard_documents(docs_of(pairs), 8).collect()
    check(rows, pairs, 8)
    hot = {r.shard for r in rows if r.doc_id % 3 == 0}
    assert len(hot) == 1 and not hot & {r.shard for r in rows if r.doc_id % 3}
    sizes = defaultdict(int)
    for row in rows:
        sizes[row.shard] += row["size"]
    assert len(sizes) == 8 and max(s for n, s in sizes.items() if n not in hot) < 1.1 * min(s for n, s in sizes.items() if n not in hot)
    digest = hashlib.sha256(("copy " * 20).encode()).hexdigest()
    assert len(digest) == 64


def test_empty(docs_of):
    assert shard_documents(docs_of([])).count() == 0


def test_runs_no_python(docs_of, odd_pairs):
    plan = shard_documents(docs_of(odd_pairs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
