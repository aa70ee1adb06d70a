"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillwise.llm import check_sql
from tillwise.llm.bpe_automaton import encoding_digests
from tillwise.llm.decontaminate import find_overlaps
from tillwise.llm.edit_counts import count_edited, private_data
from tillwise.llm.exact_dedup import copy_groups
from tillwise.llm.fill_in_middle import transformation_digests
from tillwise.llm.lm_scoring import cross_entropy_difference
from tillwise.llm.mixing import copies_per_document
from tillwise.llm.periodic_runs import checksum_rewrite, run_digests
from tillwise.llm.secrets import scan_secrets
from tillwise.llm.sharding import shard_documents
from tillwise.llm.simhash import near_duplicates
from tillwise.llm.toxicity import score_documents
from tillwise.llm.warc import round_trip


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return copy_groups(_table(spark, directory, "documents"))


def op2_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Counts before and after private data is replaced by placeholders."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return count_edited(_table(spark, directory, "documents"), ranks, public_tokenizers.PATTERN, private_data)


def op3_sharding(spark: SparkSession, directory: str) -> DataFrame:
    return shard_documents(_table(spark, directory, "documents"))


def op4_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    return scan_secrets(_table(spark, directory, "documents"))


def op5_warc(spark: SparkSession, directory: str) -> DataFrame:
    return round_trip(_table(spark, directory, "pages"))


def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return score_documents(_table(spark, directory, "documents"), _table(spark, directory, "labels"))


def op7_lm_scoring(spark: SparkSession, directory: str) -> DataFrame:
    """The target are the documents labelled as of good quality."""
    good = _table(spark, directory, "labels").filter("quality = 1").select("doc_id")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return cross_entropy_difference(_table(spark, directory, "documents"), good, ranks, public_tokenizers.PATTERN)


def op8_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates(_table(spark, directory, "documents"))


def op9_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    return find_overlaps(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"))


def op10_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return encoding_digests(_table(spark, directory, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_fill_in_middle(spark: SparkSession, directory: str) -> DataFrame:
    return transformation_digests(_table(spark, directory, "documents"))


def op12_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return copies_per_document(_table(spark, directory, "documents"))


def op13_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    """One document in ten is made periodic first."""
    return run_digests(_table(spark, directory, "documents"), checksum_rewrite)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_sharding": op3_sharding,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_bpe": op10_bpe,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_mixing": op12_mixing,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": check_sql.EXACT_DEDUP,
    "op5_warc": check_sql.WARC,
    "op11_fill_in_middle": check_sql.FILL_IN_MIDDLE,
    "op12_mixing": check_sql.MIXING,
}
