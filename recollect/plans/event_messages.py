"""Conversations made from the events table, for queries that need every rule to fire.

The expressions are plain SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTENTS = {
    0: "'We decided to use store ' || N || ' for config'",
    1: "'The import of batch ' || N || ' is finished'",
    2: "'Currently integrating module ' || N || ' for export'",
    3: "'The fix for ticket ' || N || ' is still pending'",
    4: "'How should we handle item ' || N || ' when all workers are busy?'",
    5: "'I prefer short answers for topic ' || N",
    6: "'We created service-' || N",
    7: "'Please respond in english for ' || N || '. We chose plan ' || N || '!'",
    8: "'We are using ~/.app/' || N || '.json with v1.5'",
    9: "'I am building a tool called tool-' || N",
    10: "'We decided ' || repeat('very ', 40) || N",
    11: "'Done!'",
    12: "'The published package is @scope/pkg-' || N || ' on npm'",
    13: "'hello team what do you think about ' || N || '?'",
}


def sql(events: str) -> str:
    """conv_id, turn, role, content from a relation of events."""
    n = "CAST(event_id AS VARCHAR(20))"
    cases = " ".join(f"WHEN event_id % 14 = {k} THEN {v.replace('N ', n + ' ').replace('|| N', '|| ' + n)}" for k, v in CONTENTS.items())
    return (
        "SELECT user_id AS conv_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS BIGINT) AS turn, "
        "CASE WHEN event_id % 5 = 0 THEN 'system' WHEN event_id % 5 = 1 THEN 'assistant' ELSE 'user' END AS role, "
        f"CASE WHEN user_id % 5 = 0 THEN 'Topic ' || {n} || ' goes on. More text' {cases} END AS content FROM {events}"
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql("{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
