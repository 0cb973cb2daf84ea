"""The corpus pipeline: each stage is one operator of the llm subpackage, written and read again.

Rows with null texts, null or repeated doc_ids and any further columns pass the stages as each operator's
docstring defines; the last stage returns ids instead of texts.

A task holds few whole texts at once: ``SMALL_BATCHES`` bounds what Spark's reader decodes together and what goes to a
Python worker together.  The stages' results are written by their caller, so these settings stay in the session.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliomill.llm import common, decontaminate, pieces, pii, quality, similar

SMALL_BATCHES = common.SMALL_BATCHES


def small_batches(stage: Callable) -> Callable:
    """The stage, run under ``SMALL_BATCHES``."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_rows(docs, quality.train(docs, common.documents(spark, sf_dir, "labels")))


@small_batches
def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return similar.one_per_group(docs)


@small_batches
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean_rows(docs, common.documents(spark, sf_dir, "benchmark"))


@small_batches
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates."""
    return pii.replace_rows(docs, pii.QUERY_KEY)


@small_batches
def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become SentencePiece ids: doc_id, n_tokens, ids, restored."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), rule="model")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", similar_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]
# The trees of the first stage cannot be written as SQL; tests hold the stages against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what one stage keeps is written and is the next one's input."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
