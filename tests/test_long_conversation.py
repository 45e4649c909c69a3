"""Chunks of a conversation with more than 15,000 old messages stay apart from the next conversation."""

from pyspark.sql import functions as F

from recollect import registry


def test_chunk_keys(spark, tmp_path):
    long = spark.range(15_030).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"))
    short = spark.range(20_000, 20_040).select(F.col("id").alias("event_id"), F.lit(2).cast("long").alias("user_id"))
    both = long.union(short).withColumn("ts", F.timestamp_seconds("event_id"))
    both.write.parquet(f"{tmp_path}/both/events.parquet")
    both.where("user_id = 2").write.parquet(f"{tmp_path}/short/events.parquet")
    chunks = registry.chunk_facts(spark, f"{tmp_path}/both")
    # 15,020 old messages make the chunks 0 to 1001, 30 the chunks 0 and 1.
    assert {tuple(r) for r in chunks.groupBy("conv_id").agg(F.count("*"), F.max("chunk_id")).collect()} == {(1, 1002, 1001), (2, 2, 1)}
    merged = {r.conv_id: r for r in registry.QUERIES["merge_summaries"](spark, f"{tmp_path}/both").collect()}
    alone = registry.QUERIES["merge_summaries"](spark, f"{tmp_path}/short").collect()
    assert [merged[2]] == alone and merged[1].project == "chunk 2001"
