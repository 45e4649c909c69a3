"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the contracts: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. A local session may do without: it gets a folder of the
    machine. On a cluster that would be one folder a machine, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="recollect-checkpoints-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives lost executors."""
    spark = df.sparkSession
    shared = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def drop(spark: SparkSession, path: str, at_end: bool = False) -> None:
    """Delete a folder of the shared ones, now or when the session ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_end:
        files.mkdirs(at)
        files.deleteOnExit(at)
    else:
        files.delete(at, True)


def by_bytes(batch: pa.RecordBatch, text: int, most: int = 4 << 20, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `most` bytes in the column `text`, a row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    block = np.cumsum(size) // most
    start = 0
    for end in (*(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows):
        for s in range(start, end, rows):
            yield batch.slice(s, min(rows, end - s))
        start = end


def give_back() -> None:
    """Return to the system what this worker has freed but still holds."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with freed memory given back before and after: workers serve one stage after another."""

    def wrapped(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def sent_once(spark: SparkSession, value: object, most: int = 256 << 20) -> Broadcast:
    """A broadcast of fitted state, whose size must not exceed `most` bytes."""
    made = spark.sparkContext.broadcast(value)
    size = os.path.getsize(made._path) if made._path else 0
    if size > most:
        raise ValueError(f"fitted state of {size} bytes; at most {most} are broadcast")
    return made


def n_words(text: Column) -> Column:
    """Number of words of the contracts; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fixed folds of the contracts."""
    return F.crc32(F.col(key).cast("string")) % n
