"""Summaries kept up to date from a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recollect.functions import lexicon as L
from recollect.plans.compaction import compact


def follow(stream: DataFrame, history: str, summaries: str, checkpoint: str, keep_last: int = L.DEFAULT_KEEP) -> StreamingQuery:
    """Append each batch to the message table at `history` and write the summaries of the conversations it touches.

    A batch is written under its own number, so a batch that runs again replaces itself. Readers take, for every
    conversation, the row of the greatest batch."""

    def batch(new: DataFrame, epoch: int) -> None:
        spark = new.sparkSession
        new.select("conv_id", "turn", "role", "content").write.mode("overwrite").parquet(f"{history}/batch={epoch}")
        every = spark.read.parquet(history).where(f"batch <= {epoch}").drop("batch")
        touched = spark.read.parquet(f"{history}/batch={epoch}").select("conv_id").distinct()
        compact(every.join(touched, "conv_id", "left_semi"), keep_last).write.mode("overwrite").parquet(f"{summaries}/batch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
