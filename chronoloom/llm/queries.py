"""The operators' queries over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import bpe, clustering, codes, decontaminate, langid, licenses, pii, quality, secrets, sharding, simhash, substring, warc
from chronoloom.llm.shared import table


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the tokenizer in use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from a bounded sample of those that aren't held out. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of a document that another one has too. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return substring.report(table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates of every document. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return licenses.report(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return pii.report(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and what they decode to. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector. Nulls, ties, repeated rows and other columns: see the module."""
    return clustering.report(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector. Nulls, ties, repeated rows and other columns: see the module."""
    return codes.report(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. Nulls, empty and long texts, ties, repeated rows and other columns: see the module."""
    return secrets.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_decontamination, op4_warc, op5_simhash, op6_sharding, op7_substring_dedup, op8_licences, op9_pii, op10_bpe, op11_clustering, op12_vector_codes, op13_secrets)}
