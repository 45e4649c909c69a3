"""Reading messages and writing results."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.window import COLUMNS, messages

NESTED = "array<struct<role:string,content:string>>"
#: What the prompt format says of a conversation that was left as it is.
NOTHING = "Nothing was compressed"
FORMATS = ("prompt", "messages", "summary", "full")


def from_rows(spark: SparkSession, rows: list[dict], conv_id: int = 0) -> DataFrame:
    """An ordered list of {role, content}; a content that is a list or an object counts as its JSON text."""
    if not isinstance(rows, list):
        raise ValueError("messages must be an array")
    text = lambda c: c if c is None or isinstance(c, str) else json.dumps(c, ensure_ascii=False, separators=(",", ":"))
    return spark.createDataFrame([(conv_id, i, r.get("role"), text(r.get("content"))) for i, r in enumerate(rows)], "conv_id long, turn long, role string, content string")


def from_parquet(spark: SparkSession, path: str, content: str = "text") -> DataFrame:
    return messages(spark.read.parquet(path), content)


def exploded(df: DataFrame) -> DataFrame:
    """conv_id, value -> messages; a value that is no JSON array of messages raises when it is read."""
    ok = F.regexp_like("value", F.lit(r"^\s*\[")) & F.from_json("value", NESTED).isNotNull()
    checked = F.when(ok, F.from_json("value", NESTED)).otherwise(F.raise_error(F.lit("input must be a JSON array of messages")))
    return df.select("conv_id", F.posexplode(checked).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content")


def from_json_files(spark: SparkSession, path: str) -> DataFrame:
    """A conversation a file, each a JSON array of {role, content}; conv_id is a hash of the file's path."""
    return exploded(spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("conv_id"), "value"))


def from_text(spark: SparkSession, text: str, conv_id: int = 0) -> DataFrame:
    return exploded(spark.createDataFrame([(conv_id, text)], "conv_id long, value string"))


def from_stdin(spark: SparkSession, stream: TextIO = sys.stdin) -> DataFrame:
    return from_text(spark, stream.read())


def summary_json(row: dict) -> dict:
    names = {"in_progress": "inProgress", "open_questions": "openQuestions"}
    keys = ("project", "decisions", "completed", "in_progress", "preferences", "open_questions")
    return {names.get(k, k): row[k] for k in keys} | ({"_raw": row["raw"]} if row.get("raw") else {})


def formatted(row: dict, msgs: list[dict], form: str) -> str:
    """One conversation's result as text: prompt, messages, summary or (any other form) everything."""
    summary = None if row["prompt_block"] is None else row["paragraph"] if row["paragraph"] is not None else summary_json(row)
    if form == "prompt":
        return row["prompt_block"] or NOTHING
    if form == "messages":
        return json.dumps(msgs, indent=2, ensure_ascii=False)
    if form == "summary":
        return summary if isinstance(summary, str) else json.dumps(summary, indent=2, ensure_ascii=False)
    meta = {"originalMessageCount": row["original_message_count"], "compressedCount": row["compressed_count"], "keptRaw": row["kept_raw"], "tokenCount": row["token_count"], "savedTokenCount": row["saved_token_count"], "mode": row["mode"]} | ({"note": row["note"]} if row["note"] else {}) | ({"compressedAt": row["compressed_at"].isoformat()} if row["compressed_at"] else {})
    return json.dumps({"messages": msgs, "summary": summary, "promptBlock": row["prompt_block"], "meta": meta}, indent=2, ensure_ascii=False)


def prompt_texts(compacted: DataFrame) -> DataFrame:
    """conv_id, prompt: the prompt format of every conversation."""
    return compacted.select("conv_id", F.coalesce(F.nullif("prompt_block", F.lit("")), F.lit(NOTHING)).alias("prompt"))


def write_messages(df: DataFrame, path: str, form: str = "parquet") -> None:
    """The messages as a table of files (parquet, json or orc)."""
    df.select(*COLUMNS).write.format(form).save(path)
