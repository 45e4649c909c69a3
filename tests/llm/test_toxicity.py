import random

import numpy as np
import pytest

from recollect.llm.common import fold
from recollect.llm.toxicity import FEATURES, Trees, Weigher, features, isotonic, score, train


def test_isotonic_is_the_monotone_fit():
    x, y = np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0])
    at, v = isotonic(x, y, np.ones(6))
    assert np.interp(x, at, v).tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1 / 3, 1, 1])


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4)).astype(float)
    raw = Trees(rounds=30).fit(x, y, np.ones(2000)).raw(x)
    assert ((raw > 0) == (y == 1)).mean() > 0.98


def test_features():
    f = dict(zip(FEATURES, features(["You are an idiot, YOU 1d10t!!"], Weigher({}))[0]))
    assert f["base_any"] == 1 and f["masked_density"] > 0 and f["near_second"] > 0 and f["exclaim_rate"] > 0
    assert features(["", "   "], Weigher({})).sum() == 0


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(4)
    vocab = ["ante", "brol", "cemi", "dola", "efra", "gunt"]
    rows, labels = [], []
    for i in range(1500):
        words = [r.choice(vocab) + r.choice(vocab) for _ in range(r.randint(5, 60))]
        toxic = int(r.random() < 0.3)
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "zorgul" + r.choice(vocab)]))
        rows.append((i, " ".join(words), "x", 0))
        labels.append((i, toxic, "t"))
    rows += [(9000, None, "x", 0), (9001, "", "x", 0), (9002, "idiot " * 100_000, "x", 0), (None, "abc", "x", 0), (3, "again", "x", 0)]
    labels += [(None, 1, "t"), (7, None, "t"), (5, 1, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, y int")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = score(docs, train(docs, known, fold("doc_id", 5) != 0)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    import zlib

    held = {i: t for i, t, _ in labels[:1500] if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [x.predicted == held[x.doc_id] for x in got if x.doc_id in held]
    assert np.mean(right) > 0.97


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.predicted for x in score(docs, train(docs, none, fold("doc_id", 5) != 0)).collect()] == [0]
    assert score(docs.where("false"), train(docs.where("false"), none, fold("doc_id", 5) != 0)).collect() == []


def test_trees_against_a_walk():
    """Scores of the trees against one walk a row, and splits against the best of all by brute force."""
    import numpy as np

    from recollect.llm.toxicity import Trees

    r = np.random.default_rng(4)
    x = r.integers(0, 5, (300, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    w = np.ones(300)
    t = Trees(rounds=5, depth=2).fit(x, y, w)

    def walk(row):
        score = t.base
        for on, at, value in t.trees:
            node = 0
            for level in range(2):
                j = on[level][node]
                node = 2 * node + (sum(e < row[j] for e in t.edges[j]) > at[level][node])
            score += value[node]
        return score

    assert np.allclose(t.raw(x), [walk(row) for row in x])
    q = 1 / (1 + np.exp(-t.base))
    g, h = y - q, np.full(300, q * (1 - q))

    def gain(mask):
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + t.penalty)
        return part(mask) + part(~mask) - part(np.ones(300, bool))

    best = max(gain(x[:, j] <= e) for j in range(3) for e in np.unique(x[:, j])[:-1])
    on, at, _ = t.trees[0]
    binned = sum((x[:, [on[0][0]]] > e).astype(int) for e in t.edges[on[0][0]])[:, 0]
    assert abs(gain(binned <= at[0][0]) - best) < 1e-9


def test_features_against_plain_counts():
    from recollect.llm.toxicity import FEATURES, INSULTS, SECOND, Weigher, features

    r = random.Random(6)
    words = [*INSULTS[:5], "you", "your", "fine", "st*pid", "1d10t", "HELLO", "soooo", "ok!!", "day"]
    for n in (0, 1, 7, 500):
        text = " ".join(r.choice(words) for _ in range(n))
        got = dict(zip(FEATURES, features([text], Weigher({}))[0], strict=True))
        plain = [w.strip("!") for w in text.lower().split()]
        assert got["base_density"] == pytest.approx(sum(w in INSULTS for w in plain) / max(1, n))
        assert got["second_density"] == pytest.approx(sum(w in SECOND for w in plain) / max(1, n))
        assert got["capital_rate"] == pytest.approx(sum(c.isupper() for c in text) / max(1, len(text)))
        assert got["exclaim_rate"] == pytest.approx(text.count("!") / max(1, len(text)))
        assert got["digit_rate"] == pytest.approx(sum(c.isdigit() for c in text) / max(1, len(text)))
        hits = [i for i, w in enumerate(plain) if w in INSULTS or w == "1d10t"]
        near = sum(any(abs(i - j) <= 5 for j, w in enumerate(plain) if w in SECOND) for i in hits)
        assert got["near_second"] == pytest.approx(near / max(1, n))
