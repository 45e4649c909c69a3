"""Compaction of conversations: recent messages stay, older ones become a summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T
from recollect.operators import extract, merge, parse, providers, render, window

STYLES = ("structured", "paragraph")
#: Notes of a result.
NO_PROVIDER = "Summarised by rules: no provider was named"
SHORT = "Kept whole: no message is older than those to keep"
FAILED = "Summarised by rules: the call failed: "


def token_stats(split: DataFrame) -> DataFrame:
    """conv_id, n, n_old, n_tail, original_tokens (of the old messages). Aggregates before the shuffle."""
    cost = T.message_tokens(F.col("role"), F.col("content"))
    return split.groupBy("conv_id").agg(F.max("n").alias("n"), F.sum(F.col("is_old").cast("long")).alias("n_old"), F.sum(F.col("is_tail").cast("long")).alias("n_tail"), F.coalesce(F.sum(F.when(F.col("is_old"), cost)), F.lit(0)).cast("long").alias("original_tokens"))


def token_free(split: DataFrame, lex: L.Lexicon = L.Lexicon()) -> DataFrame:
    """Counts of every conversation; summary and prompt block of those with old messages, null for others."""
    df = extract.condense(split, lex)
    df = df.withColumn("prompt_block", render.prompt_block(F.col("project"), {b: F.col(b) for b in L.BUCKETS}))
    old = F.col("n_old") > 0
    return df.select("conv_id", "n", "n_old", "n_tail", "original_tokens", *(F.when(old, F.col(c)).alias(c) for c in ("project", *L.BUCKETS, "prompt_block")))


def beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by conv_id, which may be null."""
    right = right.withColumnRenamed("conv_id", "_conv")
    return left.join(right, left.conv_id.eqNullSafe(right._conv), how).drop("_conv")


def compact(
    msgs: DataFrame, keep_last: int = L.DEFAULT_KEEP, *, style: str = "structured", ask: Callable[[str, str], tuple[str, int]] | None = None, provider: str | None = None,
    api_key: str | None = None, model: str | None = None, categories: tuple[str, ...] = ("project", *L.BUCKETS), chunked: bool = False, at_once: int | None = None,
    compat: bool = False, lex: L.Lexicon = L.Lexicon(),
) -> DataFrame:
    """One row a conversation: mode, summary, prompt_block, counts, note and compressed_at.

    Conversations of keep_last messages or fewer pass through: no summary, counts 0. Without provider (or ask, a
    function of system and user text that stands for one) the rules of extract make the summary. With one, structured
    style asks it once to improve that draft, or chunk by chunk with a merge if `chunked`; paragraph style asks chunk
    by chunk and keeps the last paragraph. A conversation whose call fails keeps its draft and notes why. keep_last
    below 1 needs compat. A null conv_id is a conversation like others; without messages there are no rows.
    """
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    split = window.split_window(msgs, keep_last, compat=compat)
    draft = token_free(split, lex)
    note = F.lit(NO_PROVIDER)
    if ask is None and provider:
        name = providers.known(provider)
        key = providers.key_of(name, api_key)
        if name != "ollama" and not key:
            note = F.lit(f"{FAILED}apiKey is required")
        elif name == "ollama" and not providers.ollama_running():
            note = F.lit("Summarised by rules: ollama does not answer")
        else:
            ask = lambda system, user: providers.send(name, system, user, key, model)
    none = F.lit(None).cast("string")
    if ask is None:
        rows = draft.select("*", F.lit("token-free").alias("mode"), none.alias("raw"), none.alias("paragraph"), F.lit(0).cast("long").alias("token_count"), note.alias("note"))
    else:
        rows = _asked(split.where("is_old"), draft, ask, provider, style, categories, chunked, at_once)
    short = F.col("n_old") == 0
    saved = F.greatest(F.lit(0), F.col("original_tokens") - T.tokens(F.col("prompt_block"))).cast("long")
    return rows.select(
        "conv_id", F.when(short, "passthrough").otherwise(F.col("mode")).alias("mode"), "project", *L.BUCKETS, "raw", "paragraph", "prompt_block",
        F.col("n").alias("original_message_count"), F.col("n_old").alias("compressed_count"), F.col("n_tail").alias("kept_raw"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"), F.when(short, 0).otherwise(saved).cast("long").alias("saved_token_count"), F.when(short, SHORT).otherwise(F.col("note")).alias("note"),
        F.when(~short, F.current_timestamp()).alias("compressed_at"),
    )


def _asked(old: DataFrame, draft: DataFrame, ask: Callable, provider: str | None, style: str, categories: tuple[str, ...], chunked: bool, at_once: int | None) -> DataFrame:
    if style == "paragraph" or chunked:
        size = L.CHUNK_SIZES.get((provider or "").lower(), L.DEFAULT_CHUNK)
        asked = window.transcripts(window.with_chunks(old, size), "conv_id", "chunk_id").select("conv_id", "chunk_id", F.lit(render.system_prompt(style)).alias("system"), F.col("transcript").alias("user"))
    else:
        asked = beside(window.transcripts(old, "conv_id"), draft.select("conv_id", "prompt_block"))
        asked = asked.select("conv_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(render.ENHANCE_PROMPT).alias("system"), render.enhance_request(F.col("prompt_block"), F.col("transcript")).alias("user"))
    replies = providers.call(asked, ask, "conv_id", "chunk_id", at_once=at_once)
    total = replies.groupBy("conv_id").agg(F.sum("tokens_used").alias("tokens"), F.max("error").alias("error"), F.max_by("text", "chunk_id").alias("last"))
    none = F.lit(None).cast("string")
    if style == "paragraph":
        made = total.select("conv_id", "tokens", "error", F.lit("").alias("p"), *(F.array().cast("array<string>").alias(f"a_{b}") for b in L.BUCKETS), none.alias("r"), T.trim(F.col("last")).alias("g"))
        block = render.paragraph_block(F.col("g"))
    else:
        one = replies.where("error IS NULL").select("conv_id", "chunk_id", parse.parse_reply(F.col("text"), categories).alias("s"))
        flat = one.select("conv_id", "chunk_id", "s.*")
        merged = beside(merge.merge_summaries(flat), flat.groupBy("conv_id").agg(F.max_by("raw", "chunk_id").alias("raw")))
        made = beside(total, merged, "left").select("conv_id", "tokens", "error", F.col("project").alias("p"), *(F.col(b).alias(f"a_{b}") for b in L.BUCKETS), F.col("raw").alias("r"), none.alias("g"))
        block = render.prompt_block(F.col("p"), {b: F.col(f"a_{b}") for b in L.BUCKETS})
    good = F.col("error").isNull() & F.col("tokens").isNotNull()
    pick = lambda yes, no: F.when(good, yes).otherwise(no)
    return beside(draft, made, "left").select(
        "conv_id", "n", "n_old", "n_tail", "original_tokens", pick(F.lit("ai"), F.lit("token-free")).alias("mode"), pick(F.col("p"), F.col("project")).alias("project"),
        *(pick(F.col(f"a_{b}"), F.col(b)).alias(b) for b in L.BUCKETS), F.when(good, F.col("r")).alias("raw"), F.when(good, F.col("g")).alias("paragraph"),
        pick(block, F.col("prompt_block")).alias("prompt_block"), pick(F.col("tokens"), F.lit(0)).cast("long").alias("token_count"), F.when(~good, F.concat(F.lit(FAILED), F.col("error"))).alias("note"),
    )


def result_messages(msgs: DataFrame, compacted: DataFrame, keep_last: int = L.DEFAULT_KEEP, *, compat: bool = False) -> DataFrame:
    """conv_id, turn, role, content: the messages that replace each conversation, the prompt block as turn -1."""
    tail = window.split_window(msgs, keep_last, compat=compat).where("is_tail").select(*window.COLUMNS)
    head = compacted.where("prompt_block IS NOT NULL").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.col("prompt_block").alias("content"))
    return head.unionByName(tail)
