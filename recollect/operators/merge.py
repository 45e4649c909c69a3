"""Fuzzy deduplication and the merge of chunk summaries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T


_OTHER = re.compile(f"[^a-z0-9{T.BLANKS}]+")


def word_set(item: str) -> set[str]:
    """As functions.text.word_set."""
    return {w for w in _OTHER.sub("", item.lower()).replace("\ufeff", " ").split() if len(w) >= 3}


def units(item: str) -> int:
    return len(item.encode("utf-16-le", "surrogatepass")) // 2


def fold(items: list[str | None], least: int) -> list[str | None]:
    """The items kept. A word's holders among the kept ones are the bits of a number, so that an item is compared with
    all of them by a few operations a word."""
    kept: list[tuple[str | None, set[str]]] = []
    holders: dict[str, int] = {}
    for item in items:
        own = word_set(item or "")
        shared = [0] * (least + 1)  # bits of those that hold n of the words seen so far
        for held in (holders.get(w, 0) for w in own):
            for n in range(least, 1, -1):
                shared[n] |= shared[n - 1] & held
            shared[1] |= held
        first = shared[least] & -shared[least]
        if not first:
            at = len(kept)
            kept.append((item, own))
        elif units(item or "") > units(kept[at := first.bit_length() - 1][0] or ""):
            for w in kept[at][1]:
                holders[w] &= ~first
            kept[at] = (item, own)
        else:
            continue
        for w in own:
            holders[w] = holders.get(w, 0) | 1 << at
    return [item for item, _ in kept]


def overlap_dedup(items: Column, least: int = 2) -> Column:
    """Fold from the left: an item that shares `least` words with a kept one replaces the first such if it is longer,
    else goes; others are kept. Every step depends on all before it, so the fold is an Arrow function a batch of lists:
    as a Column expression it compares each item with every kept one. A null list stays null; null items share nothing."""

    @F.arrow_udf("array<string>")
    def folded(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fold(x, least) for x in lists.to_pylist()], pa.list_(pa.string()))

    return folded(items)


def merge_summaries(chunks: DataFrame) -> DataFrame:
    """One summary a conversation of chunk summaries (conv_id, chunk_id, project and an array a category).

    A single chunk stays as it is. Otherwise decisions, completed and open_questions are joined in order and
    deduplicated; in_progress and preferences are those of the last chunk; the project is the last chunk's, else the
    first given."""
    joined = ("decisions", "completed", "open_questions")
    last = ("in_progress", "preferences")
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", F.col(c).alias("v")))), lambda x: x.v)).alias(c)
    given = F.when(F.col("project") != "", F.struct("chunk_id", "project"))
    df = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *(ordered(c) for c in joined), *(F.max_by(c, "chunk_id").alias(c) for c in last), F.coalesce(F.nullif(F.max_by("project", "chunk_id"), F.lit("")), F.min(given)["project"], F.lit("")).alias("project"))
    return df.select("conv_id", "project", *((F.when(F.col("n") > 1, overlap_dedup(F.col(b))).otherwise(F.col(b)) if b in joined else F.col(b)).alias(b) for b in L.BUCKETS))
