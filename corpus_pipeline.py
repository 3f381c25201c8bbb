"""From raw documents to token digests: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewgate.llm import bpe, decontaminate, language_id, quality_rules, simhash
from reviewgate.llm.frames import bounded_batches, table
from reviewgate.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts of no language learned from these rows."""
    return language_id.keep_identified(docs, language_id.train(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the current policy rejects."""
    return quality_rules.keep_passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of near copies."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every remaining text."""
    return bpe.encode_texts(
        docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=False
    )


def _bounded(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(bounded_batches(spark), docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _bounded(identify_language)),
    ("quality_rules", _bounded(apply_quality_rules)),
    ("simhash_dedup", _bounded(drop_near_duplicates)),
    ("decontaminate", _bounded(drop_leaks)),
    ("byte_bpe", _bounded(encode)),
]

#: Language, near-duplicate, alignment and token stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
