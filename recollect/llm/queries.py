"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import fold, table
from recollect.llm.oracles import ORACLES  # noqa: F401  (the other results learn, draw, approximate or need a tokenizer)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.pii import detect, digest

    return digest(detect(table(spark, sf_dir, "documents")))


@query
def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.audio import DIGEST, clips

    return clips(table(spark, sf_dir, "documents"), want=DIGEST)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    models = train(docs, fold("doc_id", 3) != 1)
    return identify(docs, models).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.suffix import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"), length=50)
