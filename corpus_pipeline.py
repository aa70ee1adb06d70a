"""Cleaning pipeline over ``documents``: each stage's result is written and read again by the next.

Every stage works on all that its predecessor kept. The first four keep or drop
whole rows and leave the columns of ``documents`` as they are, further ones and
clashing names included; the last encodes what is left.

Defined cases, for every stage: rows with NULL or repeated identifiers are rows like
any other, NULL texts count as empty, texts may have any length, and an empty table
stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillwise.llm.bpe_automaton import encoding_digests
from tillwise.llm.decontaminate import drop_contaminated
from tillwise.llm.exact_dedup import keep_first_copies
from tillwise.llm.runtime import stored
from tillwise.llm.simhash import keep_one_of_each
from tillwise.llm.toxicity import drop_toxic

SHINGLE, MAX_BITS = 3, 3
TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Without labels of both kinds their share is the score of all."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the document with the smallest identifier stays (one without only if all are).

    NULL, empty and blank texts differ as their normalised texts do: blank ones are one space.
    """
    return keep_first_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints the document with the smallest identifier stays.

    Texts without words have fingerprint zero, so one of them stays.
    """
    return keep_one_of_each(docs, SHINGLE, MAX_BITS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an overlap with a benchmark item go; texts without words have none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the documents that are left; no tokens for texts without words."""
    return encoding_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

# Trained scores, XXH64 fingerprints and tokenizer ids are beyond SQL; tests/llm/test_pipeline.py holds
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
