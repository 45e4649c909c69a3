"""Which messages stay raw, and how the others are cut in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import lexicon as L

COLUMNS = ("conv_id", "turn", "role", "content")
#: The order of the messages of a conversation. Tied turns go by role and text, so that every step orders them alike.
ORDER = ("turn", "role", "content")


def messages(df: DataFrame, content: str = "text") -> DataFrame:
    """The message columns of a table whose text column may have another name."""
    missing = {"conv_id", "turn", "role", content} - set(df.columns)
    if missing:
        raise ValueError(f"messages need the columns {sorted(missing)}")
    return df.select("conv_id", "turn", "role", F.col(content).alias("content"))


def split_window(msgs: DataFrame, keep_last: int = L.DEFAULT_KEEP, *, compat: bool = False) -> DataFrame:
    """msgs with n (messages of the conversation), rn, is_old and is_tail: the last keep_last messages are the tail.

    keep_last below 1 is an error unless compat: then 0 makes every message both old and tail, and -m makes all old
    and drops the first m from the tail. A null conv_id is a conversation like others."""
    if keep_last < 1 and not compat:
        raise ValueError("keep_last must be 1 or more")
    own = Window.partitionBy("conv_id")
    df = msgs.select(*COLUMNS, F.count(F.lit(1)).over(own).alias("n"), F.row_number().over(own.orderBy(*ORDER)).cast("long").alias("rn"))
    if keep_last < 1:
        return df.withColumn("is_old", F.lit(True)).withColumn("is_tail", F.col("rn") > -keep_last)
    old = (F.col("n") > keep_last) & (F.col("rn") <= F.col("n") - keep_last)
    return df.withColumn("is_old", old).withColumn("is_tail", ~old)


def chunk_size(provider: Column) -> Column:
    sizes = F.create_map(*(F.lit(x) for kv in L.CHUNK_SIZES.items() for x in kv))
    return F.coalesce(sizes[F.lower(provider)], F.lit(L.DEFAULT_CHUNK)).cast("long")


def with_chunks(msgs: DataFrame, size: int) -> DataFrame:
    """msgs with chunk_id: consecutive runs of `size` messages of a conversation, from 0."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(*ORDER))
    return msgs.withColumn("chunk_id", F.floor((rn - 1) / size).cast("long"))


def transcripts(msgs: DataFrame, *by: str) -> DataFrame:
    """by, transcript: the messages in order as ROLE: content, a blank line between. One row a conversation or chunk."""
    line = F.concat(F.upper("role"), F.lit(": "), F.coalesce("content", F.lit("null")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "content", line.alias("line"))))
    return msgs.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda m: m.line), "\n\n").alias("transcript"))
