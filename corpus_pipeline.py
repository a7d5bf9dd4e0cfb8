"""From raw documents to packed training sequences, one written table per stage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gritsieve.llm import exact_dedup, ngram_join, packing, substring, toxicity
from gritsieve.llm.common import read, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, accepts."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, folder, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: the smallest id."""
    return ngram_join.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of 50 words or more stay in one document only."""
    return substring.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 2048, with_ids=True)


def in_small_batches(step: Callable) -> Callable:
    """The step, with texts going to Python in batches of BATCH_BYTES at most: executors run
    several steps one after the other and have to hold batches of them beside a grown heap."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return step(spark, docs, folder)

    return run


BATCH_BYTES = 6 << 20

STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("exact_dedup", in_small_batches(drop_copies)),
    ("ngram_join", in_small_batches(drop_near_copies)),
    ("substring", in_small_batches(cut_repeats)),
    ("packing", in_small_batches(pack)),
]

#: Classifiers, minimal hashes and tokenizers have no SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and read again."""
    docs = read(spark, folder, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
