import random
import re

import numpy as np
import pytest

from recollect.llm.minhash import agreement, components, near_duplicates, signature, sketch

SCHEMA = "doc_id long, text string, id long, k1 string, h int"


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent=80):
    sets = [(d, shingles(t, size)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def near(text, changes, r):
    words = text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = r.choice(["new", "other", "word"]) + str(r.randrange(99))
    return " ".join(words)


def corpus(r, n=40):
    texts = []
    for _ in range(n):
        base = " ".join(r.choice(["Alpha", "beta", "gam", "DEL", "é", "zeta"]) + str(r.randrange(40)) for _ in range(r.randint(2, 120)))
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 4])):
            texts.append(near(base, r.choice([0, 1, 3, 6, 10]), r))
    chain = " ".join(f"c{i}" for i in range(100))
    for _ in range(25):  # neighbours are linked, ends are not
        chain = near(chain, 3, r)
        texts.append(chain)
    return texts


@pytest.mark.parametrize("size,tile", [(2, 2000), (5, 3)])
def test_against_brute_force(spark, size, tile):
    r = random.Random(size)
    texts = [None, "", " \t", "one", "ONE", "one two", "one  two\n", "\x00 \x00", "x" * 30000] + corpus(r)
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame([(d, t, 0, "s", 0) for d, t in rows], SCHEMA), words=size, tile=tile).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got) == brute(rows, size)


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a), (7, a), (7, b), (9, b), (None, b), (11, "c d"), (11, "c d")]
    got = near_duplicates(spark.createDataFrame([(d, t, 0, "s", 0) for d, t in rows], SCHEMA)).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in got) == [(0, 0, True), (5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (11, 11, True), (11, 11, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_sketch_agreement():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = signature(x), signature(np.r_[x[:900], x[:50] + np.uint64(1)])
    sa, sb = (np.frombuffer(sketch(s), np.uint8) for s in (a, b))
    assert agreement(sa, sa) == 128 and agreement(sa, sb) == int(((a & np.uint64(3)) == (b & np.uint64(3))).sum())
