"""A training-data pipeline over documents: filter, deduplicate, mask, mix and pack.

Every stage takes what the one before it kept, written as Parquet, and returns the columns of documents; the last one
returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import minhash, mixing, packing, pii, toxicity
from recollect.llm.common import drop, fold, shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model of the labelled rows outside the held-out fold."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return minhash.without_near_duplicates(docs, words=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents copied so that the sources come to their target shares of words."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("pii", mask_personal_data), ("mixing", mix_sources), ("packing", pack_sequences)]
#: The stages learn, hash and draw; SQL cannot express them. tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written as Parquet in the shared folder and read again. A result goes
    when the next one is written; the last one, which the returned rows are read from, at the end of the session."""
    docs, at, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    drop(spark, at, at_end=True)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if last:
            drop(spark, last)
        last = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
