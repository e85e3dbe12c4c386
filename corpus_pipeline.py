"""Five operators, one after another: from raw documents to packed sequences of tokens."""

from __future__ import annotations

from contextlib import ExitStack

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyframe.llm import decontaminate, near_dedup, packing, pii, toxicity
from skyframe.llm.common import Scratch, bound_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; null and empty texts score as texts without hits, and repeated rows go or stay together."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least doc_id stays, once; null and empty texts have no copies."""
    bound_batches(spark)
    return near_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go; null and empty texts stay, and so do all with an empty benchmark."""
    bound_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; null texts stay null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of at most 2048; a null or empty text is one piece with the end id."""
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("packing", pack),
]
ORACLE_SQL = None  # the stages are trained models and searches; tests hold each against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared checkpoint folder and read again by the next.

    A stage's table goes when the next one is written; the last one stays, and none if a stage fails.  Null, empty, repeated and very long rows are treated as each
    stage's docstring says; empty documents give an empty result.
    """
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    with ExitStack() as on_failure:
        on_failure.push(scratch)
        for _, stage in STAGES:
            before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
            scratch.drop(before)
        on_failure.pop_all()
    return docs
