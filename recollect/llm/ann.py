"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest distance, and
are rotated at random. Lists are k-means cells fitted on a bounded sample; every vector is in one list. Each (list,
block of vectors, block of queries) is one group of bounded size, however full a list is. A group holds its vectors
by columns: dimensions are added a block at a time, and after each block a candidate is abandoned for a query if its
partial distance exceeds what a candidate within the query's bound could show by chance (hypothesis test of random
projections). The bound of a query comes from sample vectors in its probed lists and then, within a
group, from the best found so far. Survivors are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import cut, sent_once

#: Tests: how many standard deviations a partial distance may stay above its share of the bound.
EPSILON = 1.9


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    top_norm: float
    probes: int
    sample: np.ndarray  # rotated
    sample_list: np.ndarray

    def rotate(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top_norm**2 - (x**2).sum(1)))
        return (np.c_[x, extra] @ self.rotation).astype(np.float32)

    def nearest_lists(self, r: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(1) - 2 * r @ self.centroids.T


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c.astype(np.float32)


def fit(sample: np.ndarray, rows: int, top_norm: float, *, k: int, recall: float = 0.96, per_list: int = 400, bound_sample: int = 8000, seed: int = 7) -> Index:
    """Lists of about per_list vectors or, if those are more than an eighth of the sample, so many; and as many probes as give `recall` for the sample's own vectors as queries."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1] + 1
    q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
    index = Index(q * np.sign(np.diag(r)), np.zeros((1, dims), np.float32), top_norm, 1, np.zeros((0, dims), np.float32), np.zeros(0, int))
    rotated = index.rotate(sample)
    lists = int(max(1, min(rows // per_list, len(sample) // 8)))
    index.centroids = kmeans(rotated, lists, rng) if lists > 1 else index.centroids
    own = index.nearest_lists(rotated).argmin(1)
    index.sample, index.sample_list = rotated[:bound_sample], own[:bound_sample]
    asked = rng.choice(len(sample), min(200, len(sample)), replace=False)
    scores = sample[asked].astype(np.float64) @ sample.T.astype(np.float64)
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    order = np.argsort(index.nearest_lists(index.rotate(sample[asked], query=True)), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None], 1)
    index.probes = int(np.quantile(np.take_along_axis(place, own[near], 1), recall)) + 1
    return index


def scan(q: np.ndarray, bound: np.ndarray, x: np.ndarray, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no test abandons. q, x: rotated rows; bound: squared distance a query still needs.

    Vectors are held by columns; a block of dimensions at a time is added for the vectors that some query still wants,
    then, once few pairs are left, for those pairs alone.
    """
    dims = q.shape[1]
    columns, at = np.ascontiguousarray(x.T), np.arange(len(x))
    partial = np.zeros((len(q), len(x)), np.float32)
    for a in range(0, dims, block):
        b = min(dims, a + block)
        xb, qb = columns[a:b, at], q[:, a:b]
        partial += (qb**2).sum(1)[:, None] + (xb**2).sum(0)[None] - 2 * qb @ xb
        limit = bound * (b / dims) * (1 + EPSILON / np.sqrt(b)) ** 2 if b < dims else bound * (1 + 1e-4) + 1e-4
        alive = partial <= limit[:, None]
        if b == dims:
            i, j = np.nonzero(alive)
            return i, at[j]
        if alive.mean() < 0.1:
            i, j = np.nonzero(alive)
            return _pairs(q, bound, columns, i, at[j], partial[i, j], b, block)
        wanted = alive.any(0)
        if wanted.mean() < 0.7:
            partial, at, alive = partial[:, wanted], at[wanted], alive[:, wanted]
        partial[~alive] = np.inf
    return np.zeros(0, int), np.zeros(0, int)


def _pairs(q: np.ndarray, bound: np.ndarray, columns: np.ndarray, i: np.ndarray, j: np.ndarray, partial: np.ndarray, a: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    dims = q.shape[1]
    while a < dims:
        b = min(dims, a + block)
        for d in range(a, b):
            partial = partial + (q[i, d] - columns[d, j]) ** 2
        limit = bound[i] * (b / dims) * (1 + EPSILON / np.sqrt(b)) ** 2 if b < dims else bound[i] * (1 + 1e-4) + 1e-4
        alive = partial <= limit
        i, j, partial, a = i[alive], j[alive], partial[alive], b
    return i, j


def _matrix(column: pa.Array, dims: int, kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, recall: float = 0.96, vectors_a_block: int = 8192, queries_a_block: int = 2048, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for every row where is_query holds, its own id left out.

    score is the inner product of the original vectors in double precision; ties go to the smaller vec_id. Vectors
    that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of another
    length are searched among their like, an index a length. Repeated rows are candidates of their own. With fewer than
    k candidates all come back. An empty table gives no rows; other columns are not read. An index is fitted on about
    sample_rows vectors; all are indexed.
    """
    spark = vectors.sparkSession
    exact = "double" if dict(vectors.dtypes)[vector_col] == "array<double>" else "float"
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{exact}>").alias("v"), is_query.alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("sq")).orderBy("d").collect()  # a row a length
    kind = np.float64 if exact == "double" else np.float32
    found = [_search(rows.where(F.size("v") == r.d), r.d, r.n, float(np.sqrt(r.sq)) * (1 + 1e-6), kind, k, sample_rows, recall, vectors_a_block, queries_a_block, seed) for r in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)


def _search(rows: DataFrame, dims: int, n: int, top: float, exact: type, k: int, sample_rows: int, recall: float, vectors_a_block: int, queries_a_block: int, seed: int) -> DataFrame:
    """search over vectors of one length: id, v, asks."""
    spark = rows.sparkSession
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30) < min(1.0, sample_rows / n)).select("id", "v").toArrow().sort_by("id")
    sample = np.array(drawn.column("v").to_pylist(), np.float32).reshape(-1, dims)
    if not len(sample):
        sample = np.array([r.v for r in rows.select("v").take(100)], np.float32)
    index = fit(sample[:: max(1, len(sample) // (2 * sample_rows))], n, top, k=k, recall=recall, seed=seed)
    lists, wide = len(index.centroids), dims + 1
    sent = sent_once(spark, index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                v = np.array(part.column(1).to_pylist(), exact).reshape(-1, dims)
                r = index.rotate(v)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(index.nearest_lists(r).argmin(1).astype(np.int32)), pa.array([x.tobytes() for x in r], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "asks", "lst", "r", "v"])

    placed = cut(rows.select("id", "v", "asks").mapInArrow(assign, "id long, asks boolean, lst int, r binary, v binary"))
    counts = np.zeros(lists, int)
    for r in placed.groupBy("lst").count().collect():  # a row a list
        counts[r.lst] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                r = index.rotate(_matrix(part.column(1), dims, exact), query=True)
                order = np.argsort(index.nearest_lists(r), axis=1, kind="stable")
                # Enough lists for k candidates besides the query itself.
                probes = np.maximum(index.probes, (np.cumsum(counts[order], 1) < k + 1).sum(1) + 1).clip(max=lists)
                probed = np.zeros((len(r), lists), bool)
                for i, m in enumerate(probes):
                    probed[i, order[i, :m]] = True
                d = (r**2).sum(1)[:, None] + (index.sample**2).sum(1)[None] - 2 * r @ index.sample.T
                d[~probed[:, index.sample_list]] = np.inf
                # The 2k-th of the sample: enough are within the bound even if a test abandons some.
                bound = np.partition(d, 2 * k, axis=1)[:, 2 * k] if d.shape[1] > 2 * k else np.full(len(r), np.inf)
                i, lst = np.nonzero(probed & (counts > 0)[None])
                raw = [x.tobytes() for x in r]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(lst.astype(np.int32)), pa.array(bound[i].astype(np.float32)), pa.array([raw[x] for x in i], pa.binary()), part.column(1).take(pa.array(i))], ["id", "lst", "bound", "r", "v"])

    asked = placed.where("asks").select("id", "v").mapInArrow(probe, "id long, lst int, bound float, r binary, v binary")
    asked = cut(asked)
    wanted = {r.lst: r["count"] for r in asked.groupBy("lst").count().collect()}
    blocks = spark.createDataFrame([(i, -(-max(1, int(counts[i])) // vectors_a_block), -(-c // queries_a_block)) for i, c in sorted(wanted.items())] or [(-1, 1, 1)], "lst int, vb int, qb int")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # blocks has a row a list, an eighth of the sample at most.
    left = placed.join(F.broadcast(blocks), "lst").withColumn("vk", salt("vb")).withColumn("qk", every("qb")).select("lst", "vk", "qk", "id", "r", "v")
    right = asked.join(F.broadcast(blocks), "lst").withColumn("qk", salt("qb")).withColumn("vk", every("vb")).select("lst", "vk", "qk", "id", "bound", "r", "v")

    def group(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if x.num_rows and y.num_rows:
            ids, qids = x.column("id").to_numpy(), y.column("id").to_numpy()
            xr, xv = _matrix(x.column("r"), wide), _matrix(x.column("v"), dims, exact).astype(np.float64)
            yr, yv = _matrix(y.column("r"), wide), _matrix(y.column("v"), dims, exact).astype(np.float64)
            bound, reach = y.column("bound").to_numpy().astype(np.float64), (yr.astype(np.float64) ** 2).sum(1) + top**2
            for s in range(0, len(qids), 256):
                i, j, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
                limit = bound[s : s + 256].copy()
                for c in range(0, len(ids), 2048):
                    p, q = scan(yr[s : s + 256], limit, xr[c : c + 2048])
                    p, q = p + s, q + c
                    other = qids[p] != ids[q]
                    p, q = p[other], q[other]
                    new = [(yv[p[a : a + 50_000]] * xv[q[a : a + 50_000]]).sum(1) for a in range(0, len(p), 50_000)]
                    i, j, score = np.concatenate([i, p]), np.concatenate([j, q]), np.concatenate([score, *new])
                    best = np.lexsort((ids[j], -score, i))
                    i, j, score = i[best], j[best], score[best]
                    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
                    place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                    # Whoever has k already needs no vector beyond the distance of its k-th.
                    kth = place == k - 1
                    limit[i[kth] - s] = np.minimum(limit[i[kth] - s], reach[i[kth]] - 2 * score[kth])
                    i, j, score = i[place < k], j[place < k], score[place < k]
                out.append((qids[i], ids[j], score))
        q, v, score = (np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3))
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(v.astype(np.int64)), "score": pa.array(score.astype(float))})

    found = left.groupBy("lst", "vk", "qk").cogroup(right.groupBy("lst", "vk", "qk")).applyInArrow(group, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
