"""Each stage of the pipeline on what the one before kept, against brute force, on tables of odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from tests.llm.conftest import CLASHING, SCHEMA
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_simhash import brute_groups, brute_print
from tests.llm.test_toxicity import held
from tillwise.llm.toxicity import ToxicityModel

STAGES = dict(corpus_pipeline.STAGES)


def corpus(odd_pairs):
    """Pairs with toxic texts, copies, near copies and benchmark passages; labels; benchmark items."""
    dice = random.Random(3)
    words = ["river", "stone", "walk", "green", "paper", "window", "evening", "quiet", "letter", "market", "über", "中", "42"]
    made = lambda n: [dice.choice(words) for _ in range(n)]
    items = [(k, " ".join(made(dice.randint(14, 22)))) for k in range(5)] + [(5, None), (6, ""), (None, "walk window walk window green")]
    pairs = [(i, t) for i, t in odd_pairs if len(t or "") < 40_000]
    toxic = {}
    for number in range(1000, 1160):
        text = made(dice.randint(20, 90))
        toxic[number] = number % 4 == 0
        if toxic[number]:
            for _ in range(dice.randint(3, 6)):
                text.insert(dice.randint(0, len(text)), dice.choice(["scumbag", "moronic", "worthless"]))
        pairs.append((number, " ".join(text)))
    for number in range(2000, 2040):
        text = made(60)
        pairs.append((number, " ".join(text)))
        if number % 2:
            pairs.append((number + 100, "  ".join(text) + " "))
        if number % 3 == 0:
            pairs.append((number + 200, " ".join([*text, "end"])))
        if number % 5 == 0:
            passage = items[number % 5][1].split()
            pairs.append((number + 300, " ".join([*text[:20], *passage, *text[20:]])))
    pairs.append((None, pairs[70][1]))
    labels = [(i, 1, int(toxic.get(i, False))) for i, _ in pairs if i is not None] + [(None, 1, 1), (77_777, 0, 1), (1001, None, None)]
    return pairs, labels, items


@pytest.fixture(scope="module")
def tables(spark, odd_pairs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    pairs, labels, items = corpus(odd_pairs)
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1, "y", "z", 2, 3, "s", "t") for i, t in pairs]
    spark.createDataFrame(rows, CLASHING).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, labels, items


def text_rows(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def not_toxic(pairs, labels, items):
    known = defaultdict(int)
    for identifier, _, toxic in labels:
        if identifier is not None and toxic is not None and not held(identifier):
            known[identifier] = max(known[identifier], toxic)
    texts = defaultdict(list)
    for identifier, text in pairs:
        if identifier in known:
            texts[identifier].append(text or "")
    ids = sorted(texts)
    clean = sum(not v for v in known.values()), sum(known.values())
    model = ToxicityModel([min(texts[i]) for i in ids], [known[i] for i in ids], clean)
    return [pair for pair, score in zip(pairs, model.scores([t for _, t in pairs])) if score < 0.7]


def rank(pair):
    return pair[0] is None, pair[0] or 0


def first_copies(pairs, labels, items):
    groups = defaultdict(list)
    for identifier, text in pairs:
        groups[re.sub("[ \t-\r]+", " ", text or "")].append((identifier, text))
    return [min(group, key=rank) for group in groups.values()]


def one_of_each(pairs, labels, items):
    groups = defaultdict(list)
    for pair, group in zip(pairs, brute_groups([brute_print(t) for _, t in pairs], 3)):
        groups[group].append(pair)
    return [min(group, key=rank) for group in groups.values()]


def without_passages(pairs, labels, items):
    hit = {d for d, _, _ in overlaps([t for _, t in pairs], [t for _, t in items])}
    return [pair for number, pair in enumerate(pairs) if number not in hit]


def encoded(pairs, labels, items):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = []
    for identifier, text in pairs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        found.append((identifier, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    return found


BRUTE = {
    "toxicity": not_toxic, "exact_dedup": first_copies, "simhash_near_dedup": one_of_each,
    "benchmark_decontamination": without_passages, "bpe_encoding": encoded,
}


def alike(found, expected):
    """Of rows that share the identifier, copies may differ in white space only."""
    shown = lambda rows: Counter((i, " ".join((t or "").encode().split().__repr__().split())) for i, t in rows)
    return shown(found) == shown(expected)


def test_stages_one_by_one(spark, tables):
    folder, labels, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = text_rows(docs)
        expected = BRUTE[name](before, labels, items)
        result = stage(spark, docs, folder)
        if name == "bpe_encoding":
            assert Counter(map(tuple, result.collect())) == Counter(expected)
            break
        assert result.schema == docs.schema
        found = text_rows(result)
        assert alike(found, expected), name
        # each stage has something to do, and leaves something
        assert 0 < len(found) < len(before), name
        path = f"{folder}/stage-{number}"
        result.write.parquet(path)
        docs = spark.read.parquet(path)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(tuple, whole)) == Counter(expected)


def test_names_of_stages():
    assert list(STAGES) == list(BRUTE) and corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go_and_clean_ones_stay(spark, tables):
    folder, labels, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {i for i, _ in text_rows(STAGES["toxicity"](spark, docs, folder))}
    ids = {i for i in range(1000, 1160)}
    assert {i for i in ids if i % 4 == 0} & kept == set()
    assert ids & kept == {i for i in ids if i % 4}


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_without_labels_and_benchmark_nothing_goes(spark, docs_of, odd_pairs, tmp_path):
    folder = str(tmp_path)
    docs = docs_of(odd_pairs, clashing=True)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name in ("toxicity", "benchmark_decontamination"):
        assert Counter(map(str, STAGES[name](spark, docs, folder).collect())) == Counter(map(str, docs.collect()))
