"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the copy number target / size of its source, split into a whole part and a probability for
one copy more. Two documents of a source with probabilities left meet; mass moves between them, weighted by their
sizes, until one is 0 or 1. The direction is random with odds that keep each expectation, and the expected words of
the pair never change, so a source ends within one document of its target. Documents meet along a hash of their id:
chains within buckets first, then what each chain leaves over in a tree of fixed fan-in. Nothing depends on how the
input is partitioned, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import cut, n_words

FEW_SOURCES = 10_000
MASK = (1 << 64) - 1
STATE = "doc_id long, source string, size long, copies double, bucket long, done boolean"


def _unit(*parts: int) -> float:
    """A number in [0, 1) that depends on the parts alone (splitmix64)."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = (x ^ (p & MASK)) & MASK
        x = (x + 0x9E3779B97F4A7C15) & MASK
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
        x ^= x >> 31
    return (x >> 11) / (1 << 53)


def pivot(size_a: int, a: float, size_b: int, b: float, u: float) -> tuple[float, float]:
    """Move mass between probabilities a and b in (0, 1) until one is 0 or 1, keeping size_a * a + size_b * b.

    Expectations stay: up moves a to a + d with odds e / (d + e), down to a - e otherwise.
    """
    d = min(1 - a, b * size_b / size_a)
    e = min(a, (1 - b) * size_b / size_a)
    if u * (d + e) < e:
        return (1.0, b - d * size_a / size_b) if d == 1 - a else (a + d, 0.0)
    return (0.0, b + e * size_a / size_b) if e == a else (a - e, 1.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size, target: one row a source in, one out.

    Sources by code point, null last, take the weights in turn; target = min(most * size, level * weight), where the
    level makes the targets sum to all sizes. That is the fixed point of sharing each excess anew by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    by = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    # The level is that of the first source, by cap a weight, that it leaves below its cap.
    by = by.withColumn("lvl", F.when(level * F.col("weight") <= F.col("cap"), level)).withColumn("lvl", F.max("lvl").over(everything))
    return by.select("source", "source_size", F.least(F.col("cap"), F.col("lvl") * F.col("weight")).alias("target"))


def _chain(batches: Iterator[pd.DataFrame], level: int, seed: int, last: bool) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket, source: one chain each, streaming; at most one row of a chain stays undecided."""
    held = None  # the undecided row: (bucket, source, doc, size, whole, p)
    names = ["doc_id", "source", "size", "copies", "bucket", "done"]

    def closed(h: tuple) -> tuple:
        bucket, source, doc, size, whole, p = h
        if last:
            return doc, source, size, whole + float(_unit(seed, 99, doc or 0) < p), bucket, True
        return doc, source, size, whole + p, bucket, False

    for pdf in batches:
        out = []
        for doc, source, size, copies, bucket in zip(*(pdf[c].tolist() for c in names[:5]), strict=True):
            doc = None if doc is None or doc != doc else int(doc)
            whole = float(int(copies + 1e-12))
            p = min(max(copies - whole, 0.0), 1.0)
            if held and held[:2] != (bucket, source):
                out.append(closed(held))
                held = None
            if size == 0 or p <= 1e-12:
                out.append((doc, source, size, whole, bucket, True))
            elif held is None:
                held = (bucket, source, doc, size, whole, p)
            else:
                _, _, other, o_size, o_whole, q = held
                q, p = pivot(o_size, q, size, p, _unit(seed, level, other or 0, doc or 0))
                held = None
                for d, s, w, x in ((other, o_size, o_whole, q), (doc, size, whole, p)):
                    if x <= 1e-12 or x >= 1 - 1e-12:
                        out.append((d, source, s, w + round(x), bucket, True))
                    else:
                        held = (bucket, source, d, s, w, x)
        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
    if held:
        yield pd.DataFrame([closed(held)], columns=names).astype({"doc_id": "Int64"})


def _round(rows: DataFrame, level: int, seed: int, last: bool, parts: int) -> DataFrame:
    ordered = rows.repartition(parts, "bucket", "source").sortWithinPartitions("bucket", "source", "doc_id", "size")
    return ordered.select("doc_id", "source", "size", "copies", "bucket").mapInPandas(lambda it: _chain(it, level, seed, last), STATE)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, per_bucket: int = 20_000, fan_in: int = 512, seed: int = 23) -> DataFrame:
    """id, source, size, source_size, target, copies (long), taken of every row.

    size is the number of words of the text; copies is within one of target / source_size and at most `most`
    (a whole number); taken = copies * size. A null or empty text has size 0, takes 0 words and keeps its whole part
    of copies. A null source is a source of its own, last in order. Rows repeated under one id are rows of their own.
    An empty table gives no rows; if all texts are empty all targets are 0. Other columns are not read.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = cut(sized)
    goal = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    rows = sized.count()
    buckets = max(1, -(-rows // per_bucket))
    if goal.count() <= FEW_SOURCES:  # a checked bound; beyond it Spark joins by source and splits hot ones
        goal = F.broadcast(goal)
    state = sized.join(goal, sized.source.eqNullSafe(goal.source), "left").select(
        "doc_id", sized.source, "size",
        F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("copies"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(buckets)).alias("bucket"),
    )
    level, decided = 0, []
    while True:
        last = buckets == 1
        state = cut(_round(state, level, seed, last, min(max(1, buckets), 2000) if level else max(1, min(-(-rows // per_bucket), 20_000))))
        decided.append(state.where("done"))
        if last:
            break
        buckets = -(-buckets // fan_in)
        state = state.where("NOT done").withColumn("bucket", F.pmod(F.col("bucket"), F.lit(buckets)))
        level += 1
    done = decided[0]
    for more in decided[1:]:
        done = done.unionByName(more)
    out = done.withColumn("copies", F.round("copies").cast("long")).join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """Every row of docs as often as the mix copies it, with all its columns.

    Rows of one id, source and size take the copies of such rows in any order."""
    key = [F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source")]
    drawn = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **more).select(*key, F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *key, n_words(F.col(text_col)).alias("_size"))
    n = docs.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
    if n[0] == n[1]:  # ids tell rows apart
        both = rows.join(drawn.drop("_source", "_size"), "_id")
    else:
        number = lambda by: F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(by))
        a, b = rows.withColumn("_n", number(F.lit(1))), drawn.withColumn("_n", number(F.desc("_copies")))
        b = b.toDF(*(f"{c}_b" for c in b.columns))
        on = [a[c].eqNullSafe(b[f"{c}_b"]) for c in ("_id", "_source", "_size", "_n")]
        both = a.join(b, on[0] & on[1] & on[2] & on[3]).withColumnRenamed("_copies_b", "_copies")
    many = both.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return many.select("_row.*")
