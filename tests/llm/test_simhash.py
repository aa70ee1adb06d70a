from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillwise.llm import simhash
from tillwise.llm.components import _large_star, _small_star, smallest_reachable
from tillwise.llm.runtime import stored
from tillwise.llm.simhash import _first_of_components, fingerprint, keep_one_of_each, near_duplicates


def brute_print(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    """Smallest index reachable of each."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints(odd_pairs):
    for _, text in odd_pairs:
        if text is None or len(text) < 10_000:
            assert fingerprint(text and text.encode()) == brute_print(text)


def test_components(spark):
    dice = random.Random(3)
    edges = [(dice.randint(0, 150), dice.randint(0, 150)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)]
    found = dict(map(tuple, smallest_reachable(spark.createDataFrame(edges, "u long, v long")).collect()))
    neighbours = defaultdict(set)
    for a, b in edges:
        neighbours[a].add(b)
        neighbours[b].add(a)
    for node in neighbours:
        seen, todo = {node}, [node]
        while todo:
            todo += [x for x in neighbours[todo.pop()] - seen if not seen.add(x)]
        assert found.get(node, node) == min(seen)


@pytest.mark.parametrize("tile", [2048, 8])
@pytest.mark.parametrize("radius", [1, 3])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, tile, radius):
    """Small tiles: many buckets, and crowded ones that are cut into tile pairs."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "_ONE_PIECE", 4 * tile)
    dice = random.Random(radius)
    prints = {dice.getrandbits(64) for _ in range(150)}
    for start in list(prints)[:6]:
        x = start
        for _ in range(60):
            x ^= 1 << dice.randint(0, 63)
            x ^= 1 << dice.randint(0, 63)
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "f long")
    links = [(np.int64(u).view(np.uint64), np.int64(v).view(np.uint64)) for u, v in simhash._links(frame, len(prints), radius).collect()]
    assert all((int(u) ^ int(v)).bit_count() > 0 for u, v in links)
    place = {p: i for i, p in enumerate(prints)}
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in links:
        a, b = root(place[int(u)]), root(place[int(v)])
        label[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(prints))] == brute_groups(prints, radius)


def test_two_blocks_lose_no_pair(spark):
    """Beyond 2^16 tiles a bucket is two blocks of bits."""
    dice = random.Random(4)
    rows = []
    for _ in range(300):
        a, b = dice.getrandbits(64), 0
        b = a
        for bit in dice.sample(range(64), dice.randint(0, 3)):
            b ^= 1 << bit
        rows.append((int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))))
    frame = spark.createDataFrame(rows, "a long, b long")
    buckets = lambda name: frame.select(F.col(name).alias("f")).select(simhash._buckets(1 << 36, 3)).collect()
    for left, right in zip(buckets("a"), buckets("b")):
        assert len(left[0]) == 16 and set(left[0]) & set(right[0])


def expected(pairs):
    prints = [brute_print(t) if t is None or len(t) < 50_000 else fingerprint(t.encode()) for _, t in pairs]
    groups = defaultdict(list)
    for (identifier, _), group in zip(pairs, brute_groups(prints, 3)):
        groups[group].append(identifier)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(pairs, prints, brute_groups(prints, 3))]


def test_odd_documents(docs_of, odd_pairs):
    found = near_duplicates(docs_of(odd_pairs, clashing=True)).collect()
    assert Counter(map(tuple, found)) == Counter(expected(odd_pairs))


def test_one_of_each_stays(docs_of, odd_pairs):
    docs = docs_of(odd_pairs, clashing=True)
    kept = keep_one_of_each(docs)
    assert kept.schema == docs.schema
    prints = [int(p, 16) for _, p, _ in expected(odd_pairs)]
    # an identifier that two groups share stays in both
    winners = {group: row[2] for group, row in zip(brute_groups(prints, 3), expected(odd_pairs))}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(winners.values())


def test_a_node_with_many_neighbours_is_split(spark, skewed):
    """A star whose middle has most of the edges: the smallest node for large stars, the largest for small ones."""
    for star, middle in ((_large_star, "0L"), (_small_star, "70000L")):
        edges = spark.range(1, 60_000, 1, 8).selectExpr("id AS a", f"CASE WHEN id % 10 < 9 THEN {middle} ELSE id - 1 END AS b")
        edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
        _, plan = skewed(star(edges))
        assert "skew=true" in plan


def test_a_giant_component_is_split(spark, skewed):
    """Most fingerprints are linked to one; the first row of each component is found all the same."""
    prints = spark.range(0, 20_000, 1, 8).selectExpr("id AS f", "100000 - id AS doc_id", "id AS row_no")
    root = spark.range(1, 18_000, 1, 8).selectExpr("id AS u", "0L AS v")
    rows, plan = skewed(_first_of_components(stored(prints.selectExpr("f", "struct(false AS none, doc_id, row_no) AS first"), "fingerprints"), stored(root, "root")))
    assert "skew=true" in plan
    assert {r.doc_id for r in rows if r.f < 18_000} == {82_001} and all(r.doc_id == 100_000 - r.f for r in rows if r.f >= 18_000)


def test_few_fingerprints_are_one_bucket(spark):
    frame = spark.createDataFrame([(k,) for k in range(300)], "f long")
    assert [r[0] for r in frame.select(simhash._buckets(300, 3)).distinct().collect()] == [[0]]


def test_empty(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    assert keep_one_of_each(docs_of([])).count() == 0
