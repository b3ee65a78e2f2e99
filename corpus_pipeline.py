"""A training corpus from raw documents: quality rules, near duplicates, secrets, source mix, packing.

Every stage takes any rows with the columns of documents, further columns of any
name included: nulls in any column, empty and very long texts, repeated rows and
ids, and empty tables. What becomes of them is said stage by stage; none fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import jaccard, mixing, packing, quality, secrets
from wordloom.llm.common import delete, freeing_shuffles, shared_folder, small_batches, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with cutoffs for small languages too.

    Null, empty and short texts go (under 20 words), equal rows share a verdict,
    null languages are a stratum; with empty labels only the base rules reject.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), together=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of linked ones.

    Of rows that repeat an id one stays; rows without an id stay, and texts
    without a word, which are linked with nothing.
    """
    return jaccard.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null and empty texts stay as they are."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled.

    A null source is one of its own; repeated rows are taken each; texts without
    a word count nothing and may be left out.
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences, a row for each piece; a null or empty text is one piece, the end id alone."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("source mix", mixing_stage),
    ("packing", packing_stage),
]

#: Bytes that a writing task holds before it writes them out.
ROW_GROUP = 32 << 20
#: SQL can express neither the draws of the mix nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again by the next.

    A stage's result is deleted once the next one's is written, so the folder
    holds two at most, and in the end the last. Empty documents give an empty
    result.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark), freeing_shuffles(spark):
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
    return docs
