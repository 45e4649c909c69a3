"""Packing documents into token sequences: first-fit decreasing over a tournament tree of bin capacities.

The groups are random by a hash of document and place in its partition, so each is a fair sample of all lengths and
packs about as tightly as the whole; their number follows the row count, so a group stays at about `per_group`
documents at any size. Ids never leave the encoding stage: only a piece's place, length and checksum are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import by_bytes, lean
from recollect.llm.encoding import encoder, texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long"


class Tournament:
    """Left-most bin with room for a size, in log time: each inner node holds the largest free room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            top = max(room[2 * at], room[2 * at + 1])
            if room[at] == top:
                break
            room[at] = top
        return leaf


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (all from 1 to capacity); larger first, ties in the given order."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), [0] * tree.leaves
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        b = tree.place(size)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, groups: int, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, seed: int = 17) -> DataFrame:
    """Each document's ids, then end_id, cut at multiples of capacity: place, length and crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, ordinal = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        for b in (part for whole in batches for part in by_bytes(whole, 1, rows=2000)):
            out: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(texts_of(b.column(1))), strict=True):
                view = memoryview(ids + end)
                total = len(view) // 4
                for start in range(0, total, capacity):
                    part = view[4 * start : 4 * (start + capacity)]
                    ordinal += 1
                    group = zlib.crc32(f"{seed} {doc} {start} {ordinal}".encode()) % groups
                    out.append((doc, start, len(part) // 4, zlib.crc32(part), total, group))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), PIECES)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, per_group: int = 4096, seed: int = 17) -> DataFrame:
    """Every piece with its sequence_id and offset; a sequence holds at most `capacity` ids, gapless from 0.

    A null or empty text is one piece of end_id alone. Rows repeated under one id are documents of their own and give
    repeated (id, start). An empty table gives no rows; other columns are not read. sequence_id is group * 2**31 + bin.
    Ids may be null; such rows are packed like others.
    """
    groups = max(1, -(-docs.count() // per_group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="grp").assign(sequence_id=pdf["grp"].to_numpy() * 2**31 + bins, offset=offsets)

    cut = pieces(docs, tokenizer, groups, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, seed=seed)
    packed = cut.groupBy("grp").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("doc_id", id_col)
