import random
from collections import defaultdict

import pytest

from recollect.llm.mixing import mix, pivot

SCHEMA = "doc_id long, text string, source string, bucket long, size long, target double"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, share the excess anew until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("per_bucket,fan_in", [(20_000, 512), (7, 3)])
def test_against_brute_force(spark, per_bucket, fan_in):
    r = random.Random(5)
    rows = []
    for i in range(900):
        source = r.choice(["a", "a", "a", "b", "Z", "é", None, "tiny" if i < 20 else "b"])
        text = None if i % 97 == 0 else "" if i % 101 == 0 else " ".join(["w"] * r.randint(1, 60))
        rows.append((i, text, source, 1, 1, 0.5))
    rows += rows[:10]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df, per_bucket=per_bucket, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    want, taken, biggest = brute_targets(dict(sizes)), defaultdict(int), defaultdict(int)
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert 0 <= x.taken <= 3 * x.size and abs(x.copies - x.target / x.source_size) < 1
        taken[x.source] += x.taken
        biggest[x.source] = max(biggest[x.source], x.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] + 1e-6
    again = mix(df.repartition(3), per_bucket=per_bucket, fan_in=fan_in).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_expectation_and_mass():
    r = random.Random(1)
    n, up = 20000, 0
    for _ in range(n):
        a, b = pivot(3, 0.3, 7, 0.6, r.random())
        assert 3 * a + 7 * b == pytest.approx(3 * 0.3 + 7 * 0.6) and (a in (0, 1) or b in (0, 1))
        up += a
    assert up / n == pytest.approx(0.3, abs=0.02)


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [x.taken for x in mix(spark.createDataFrame([(1, None, None, 0, 0, 0.0), (None, "", "a", 0, 0, 0.0)], SCHEMA)).collect()] == [0, 0]
