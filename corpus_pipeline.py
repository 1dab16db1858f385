"""Corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, tokens.

Each stage works on all that the one before kept. Its result is written as
Parquet in the shared folder and read again, so a lost executor repeats a part
of one stage only.

A null text has no words, so the quality rules drop its row; so they do with empty
texts. Later stages take them as the operators say: they have no windows, no spans
and no tokens, and all of them are one group of near-duplicates. A row without a
doc_id goes through like any other, and is the one that stays of its group only if
no row of the group has a doc_id. Repeated rows are near-duplicates: one stays.
Very long texts are read whole. Empty tables give empty tables. Extra columns are
carried along whatever their names, but the last stage replaces ``ids``,
``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, decontaminate, pii, quality, simhash
from chronoloom.llm.queries import tokenizer
from chronoloom.llm.shared import delete, stored, table, unused, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    name = unused(docs, "found")[0]
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), out=name)
    return found.where(~decontaminate.is_contaminated(F.col(name))).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data taken out of their texts; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and digests of the ids and of the bytes that they decode to."""
    path, pattern = tokenizer()
    name = unused(docs, "decoded")[0]
    coded = bpe.with_tokens(docs, path, pattern).withColumn(name, bpe.decoder(spark, path)(F.col("ids")))
    return coded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": bpe.ids_digest(F.col("ids")), "decoded_sha256": F.sha2(name, 256)}).drop(name)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Token ids and fingerprints cannot be computed in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what the stages wrote on the way is deleted, but for the table read by it."""
    docs, kept = table(spark, sf_dir, "documents"), set(written(spark))
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete(spark, [p for p in written(spark) if p not in kept and p != docs._stored_path])
    return docs
