"""The corpus pipeline: documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``.  All but the last return the
columns of ``docs``; what is between two stages is a written table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import decontamination, near_dups, packing, quality, secrets
from shardloom.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it is fitted on the labelled ones among them.

    Null and empty texts are judged as empty texts; rows that repeat an id or a text are judged one by one.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id; rows with one id and one text are one document.

    Several texts under one id are several documents; rows without an id go after those with one.
    Null and empty texts are near-duplicates of nothing.
    """
    return near_dups.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, in whatever letter case.

    Each text is judged by itself, whatever its id, and also without one; null and empty texts stay.
    """
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"), any_case=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the kind of secret; null texts stay null, repeated rows stay repeated."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.length("text") != F.col("n_chars")
    return clean.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of at most 2048 ids; a null or empty text is its end mark, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Fitting, connected components and encoding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
