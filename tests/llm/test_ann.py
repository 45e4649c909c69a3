import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from recollect.llm.ann import scan, search

SCHEMA = "vec_id long, embedding array<float>, score double, lst int"


def brute(rows, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 20 == 0:
            out[q] = sorted(((-float((a * b).sum()), i) for i, b in good if i != q))[:k]
    return out


def check(spark, rows, least, **more):
    got = search(spark.createDataFrame([(i, v, 0.0, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0, **more).collect()
    want, have = brute(rows), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        have[r.query_id].append((-r.score, r.vec_id))
        assert r.rank == len(have[r.query_id])
    assert set(have) == {q for q, w in want.items() if w}
    assert all(len(have[q]) == len(want[q]) and have[q] == sorted(have[q]) for q in have)
    hit = sum(sum(s <= w[-1][0] + 1e-6 for s, _ in have[q]) for q, w in want.items() if w)
    assert hit >= least * sum(map(len, want.values()))
    return have, want


def test_recall_on_plain_and_clustered(spark):
    r = np.random.default_rng(0)
    plain = r.standard_normal((3000, 24))
    check(spark, [(i, v.tolist()) for i, v in enumerate(plain)], 0.9, sample_rows=1000)
    centres = r.standard_normal((30, 24)) * 3
    near = centres[r.integers(0, 30, 3000)] + r.standard_normal((3000, 24))
    check(spark, [(i, v.tolist()) for i, v in enumerate(near)], 0.9, vectors_a_block=150, queries_a_block=20)


def test_copies_odd_rows_and_ties(spark):
    r = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 == 0 else r.standard_normal(3).tolist()) for i in range(600)]
    rows += [(1000, None), (1020, []), (1040, [0.0, 0.0, 0.0]), (1060, [1.0, None, 1.0]), (1080, [float("nan"), 1.0, 1.0]), (1100, [float("inf"), 1.0, 1.0])]
    have, want = check(spark, rows, 0.99, vectors_a_block=50, queries_a_block=7)
    assert all([i for _, i in have[q]] == [i for _, i in want[q]] for q in have if q % 3 == 0)


def test_few_and_none(spark):
    check(spark, [(i, [float(i + 1), 1.0]) for i in range(5)], 1.0)
    check(spark, [(0, [1.0, 1.0])], 1.0)
    assert search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def test_scan_abandons_only_the_far():
    r = np.random.default_rng(2)
    x, q = r.standard_normal((2000, 64)).astype(np.float32), r.standard_normal((30, 64)).astype(np.float32)
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = np.sort(d, axis=1)[:, 20]
    i, j = scan(q, bound, x)
    inside = d <= bound[:, None]
    assert (d[i, j] <= bound[i] * 1.001 + 1e-3).all() and len(i) > 0.95 * inside.sum()


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, have = brute(rows), defaultdict(set)
    for r in search(df, F.col("vec_id") % 20 == 0).collect():
        have[r.query_id].add(r.vec_id)
    assert sum(len(have[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_doubles_are_scored_as_they_are(spark):
    """A column of doubles keeps its precision; vectors of another length meet their like."""
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(60)] + [(100 + i, r.standard_normal(3).tolist()) for i in range(30)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    by = dict(rows)
    for q in (0, 20, 40, 100, 120):
        own = sorted((-float(np.dot(np.array(by[q]), np.array(v))), i) for i, v in rows if i != q and len(v) == len(by[q]))[:5]
        mine = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in own]
        assert all(abs(a[2] + b[0]) < 1e-12 for a, b in zip(mine, own, strict=True))


def test_bound_tightens_within_a_list(spark):
    """One list of many vectors, several chunks and blocks, against brute force."""
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((5000, 12)))]
    check(spark, rows, 0.9, sample_rows=100, vectors_a_block=100_000)
