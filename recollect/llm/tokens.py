"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.encoding import encoder, texts_of


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, batch_bytes: int = 1 << 20) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row.

    tokenizer: path of a tokenizers .json or sentencepiece .model file on the executors. No special tokens are added
    and nothing is truncated. Ids never leave the function. Batches hold about batch_bytes of UTF-8; longer texts are
    cut at white space where the vocabulary drops it, else encoded whole.
    Null and empty texts count 0 bytes and 0 tokens; repeated rows and ids stay; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = texts_of(b.column(1))
            n = [len(x) // 4 for x in enc.encode(texts, batch_bytes)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
