from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tillwise.llm import mixing
from tillwise.llm.mixing import copies_per_document, mixed, word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies string, target string, mark string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "c", "t", "m") for i, t, s in rows], SCHEMA)


def words(text):
    return len((text or "").encode().split())


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cut at the bound, share what was cut off again."""
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(ordered)}
    given = {s: Fraction(0) for s in sizes}
    rest, free = Fraction(sum(sizes.values())), set(sizes)
    while rest and free:
        total = sum(weight[s] for s in free)
        for s in free:
            given[s] += rest * weight[s] / total
        rest = Fraction(0)
        for s in list(free):
            if given[s] >= most * sizes[s]:
                rest += given[s] - most * sizes[s]
                given[s] = Fraction(most * sizes[s])
                free.discard(s)
    return given


def check(rows, found, most=3):
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    want, taken = targets(sizes, most=most), Counter()
    for row in found:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(float(want[row.source]), rel=1e-12, abs=1e-9)
        assert row.taken == row.copies * row["size"] <= most * row["size"]
        rate = want[row.source] / sizes[row.source] if sizes[row.source] else 0
        assert int(rate) <= row.copies <= int(rate) + 1
        taken[row.source] += row.taken
    assert Counter((r.doc_id, r["size"], r.source) for r in found) == Counter((i, words(t), s) for i, t, s in rows)
    return sizes, want, taken


@pytest.fixture(scope="module")
def corpus():
    dice = random.Random(4)
    rows = []
    for number in range(1200):
        # a third of all rows in one source, a small source that is repeated to its bound
        source = "hot" if number % 3 == 0 else dice.choice(["a", "b", "Ä", "z", "中", "", None])
        rows.append((number, "w " * dice.choice([1, 5, 40, dice.randint(1, 400)]), source))
    return [*rows, (5000, "one two three", "rare"), (5001, "four", "rare")]


def test_against_definition(spark, corpus):
    found = copies_per_document(frame(spark, corpus)).collect()
    _, want, taken = check(corpus, found)
    assert float(want["rare"]) == 12 and taken["rare"] == 12
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(400, target / 50)
    again = copies_per_document(frame(spark, corpus[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_extra_copies_are_draws(spark):
    """Each of the hashes takes about the wanted share of many documents."""
    rows = [(k, "w", s) for k in range(4000) for s in ("a", "b")]
    rates = mixing._rates(mixing._sized(frame(spark, rows), "doc_id", "text", "source"), (5, 2, 1), 3)
    chance = {r.source: r.chance for r in rates.collect()}
    taken = Counter()
    for row in copies_per_document(frame(spark, rows)).collect():
        taken[row.source] += row.copies - (1 if row.source == "a" else 0)
    assert chance["a"] == pytest.approx(10 / 7 - 1) and chance["b"] == pytest.approx(4 / 7)
    assert all(abs(taken[s] / 4000 - chance[s]) < 0.01 for s in chance)


def test_levels_of_many_sources(spark):
    dice = random.Random(9)
    for most in (1, 2, 3):
        rows = [(k, "w " * dice.choice([0, 1, 3, 50, 900]), f"s{dice.randrange(40)}") for k in range(150)]
        check(rows, copies_per_document(frame(spark, rows), most=most).collect(), most)


def test_odd_documents(spark, odd_pairs):
    dice = random.Random(6)
    rows = [(i, t, dice.choice(["x", "y", None])) for i, t in odd_pairs]
    rows += [(None, "same text", "y")] * 5 + [(None, None, "blank"), (7000, "word " * 500_000, "x"), (7001, "q" * 2_000_000, "x")]
    docs = frame(spark, rows)
    found = copies_per_document(docs).collect()
    check(rows, found)
    assert len({r.copies for r in found if r.doc_id is None and r["size"] == 2 and r.source == "y"}) == 1
    # the emitted documents are those of the table, as they were
    emitted = mixed(docs)
    assert emitted.columns == docs.columns
    counted = Counter((r.doc_id, words(r.text), r.source) for r in emitted.collect())
    want = Counter()
    for r in found:
        want[r.doc_id, r["size"], r.source] += r.copies
    assert counted == +want


def test_word_count(spark):
    texts = [None, "", " \n\t", "a", " a b\x0bc\x0cd\r\ne ", "a\xa0b\x1cc d", "x" * 50_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.select(word_count(rows.text)).collect()] == [words(t) for t in texts]


def test_empty_and_wordless(spark):
    assert copies_per_document(frame(spark, [])).count() == 0 == mixed(frame(spark, [])).count()
    found = copies_per_document(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert {(r.doc_id, r["size"], r.target, r.taken) for r in found} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_runs_no_python_and_splits_the_hot_source(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    docs = spark.range(0, 40_000, 1, 8).selectExpr(
        "id AS doc_id", "repeat('w ', int(id % 7)) AS text", "CASE WHEN id % 10 < 9 THEN 'hot' ELSE concat('s', id % 90) END AS source"
    )
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = copies_per_document(docs)
        sums = defaultdict(int)
        for row in found.collect():
            sums[row.source] += 1
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert sums["hot"] == 36_000 and "skew=true" in plan
    assert "Python" not in plan and "Arrow" not in plan
